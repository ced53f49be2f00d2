"""Ordered computations that survive a hot key.

``Window.partitionBy(key)`` puts all rows of a key into one task. The functions here cut
each key into ordered pieces, run the window inside (key, piece) and add what the earlier
pieces contribute. The carried part works on one pre-aggregated row per (key, piece), so
the only window that spans a whole key sees pieces, not rows.

``ranged_sums``, ``ranged_rank`` and ``ranged_previous`` take the pieces from the data: ranges
of about equal size in the order of (key, order), with bounds from a sample, wherever the
times lie. A key whose rows all bear one time is spread like any other.

``running_sum``, ``running_sums``, ``row_rank`` and ``previous_row`` take a ``bucket`` that the
caller names (a block of positions, an hour), which must grow with ``order`` (or shrink, with
``descending=True``): right where no bucket can be large.

Null keys are a key of their own and null order values come where the window puts them, so
a bucket may be null too; every carried join is null-safe and keeps all rows. Results equal
the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"
_RANGE, _OWN = "__range", "__of_rows"

#: Rows drawn for each range.
_SAMPLED = 32


def spread_by(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Hash-partitions by ``columns`` into the session's number of shuffle partitions.

    With the number given, adaptive execution does not merge small partitions: right
    for rows whose work (n-grams, Python) is far larger than their bytes suggest.
    """
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(number, *columns)


def join_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` in which nulls are equal; keeps each row of ``rows`` once.

    ``carried`` has one row per combination of the keys.
    """
    aside = carried.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, (rows[k].eqNullSafe(aside[f"__of_{k}"]) for k in keys)
    )
    return rows.join(aside, same, "left").drop(*[f"__of_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: Mapping[str, tuple[Column, Sequence[str]]],
    descending: bool = False,
) -> DataFrame:
    """Adds ``sum(value) over (partition by by + within order by order rows unbounded preceding)``
    for each ``name: (value, within)``.

    ``order`` must be total within a key (end it with a unique column). The rows move
    once, to (by, bucket); finer ``within`` keys are windows inside the same tasks.
    """
    cut = df.withColumn(_BUCKET, bucket)
    ends = (Window.unboundedPreceding, Window.currentRow)
    rows = cut.select(
        "*",
        *[
            F.sum(v)
            .over(Window.partitionBy(*by, _BUCKET, *within).orderBy(*order).rowsBetween(*ends))
            .alias(name)
            for name, (v, within) in sums.items()
        ],
    )
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    for within in dict.fromkeys(tuple(w) for _, w in sums.values()):
        mine = [name for name, (_, w) in sums.items() if tuple(w) == within]
        totals = cut.groupBy(*by, *within, _BUCKET).agg(
            *[F.sum(sums[name][0]).alias(name) for name in mine]
        )
        earlier = (
            Window.partitionBy(*by, *within)
            .orderBy(bucket_order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = totals.select(
            *by,
            *within,
            _BUCKET,
            *[F.sum(name).over(earlier).alias(f"__before_{name}") for name in mine],
        )
        rows = join_carried(rows, carried, [*by, *within, _BUCKET])
    return rows.select(
        *df.columns,
        *[
            (F.col(name) + F.coalesce(F.col(f"__before_{name}"), F.lit(0))).alias(name)
            for name in sums
        ],
    )


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    descending: bool = False,
) -> DataFrame:
    """``running_sums`` over ``by`` alone."""
    return running_sums(
        df, by, bucket, order, {name: (v, ()) for name, v in sums.items()}, descending
    )


def row_rank(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str,
    descending: bool = False,
) -> DataFrame:
    """Adds ``row_number() over (partition by by order by order)``."""
    return running_sum(df, by, bucket, order, {name: F.lit(1).cast("bigint")}, descending)


def previous_row(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    values: Mapping[str, Column],
) -> DataFrame:
    """Adds ``lag(value) over (partition by by order by order)``, ascending order only."""
    rows = df.withColumn(_BUCKET, bucket)
    inside = Window.partitionBy(*by, _BUCKET).orderBy(*order)
    local = rows.select(
        "*",
        F.row_number().over(inside).alias("__at"),
        *[F.lag(v).over(inside).alias(name) for name, v in values.items()],
    )
    lasts = rows.groupBy(*by, _BUCKET).agg(
        F.max_by(
            F.struct(*[v.alias(name) for name, v in values.items()]), F.struct(*order)
        ).alias("__last")
    )
    carried = lasts.select(
        *by,
        _BUCKET,
        F.lag("__last").over(Window.partitionBy(*by).orderBy(_BUCKET)).alias("__carried"),
    )
    return join_carried(local, carried, [*by, _BUCKET]).select(
        *df.columns,
        *[
            F.when(F.col("__at") == 1, F.col("__carried")[name])
            .otherwise(F.col(name))
            .alias(name)
            for name in values
        ],
    )


def ranged(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], ranges: int | None = None
) -> DataFrame:
    """Adds ``__range``: the rows, in the order of (by, order), in about equal parts.

    The bounds are taken from the rows with the smallest hashes, ``_SAMPLED`` for a range:
    a subquery of bounded size that comes out alike however often it runs. A row finds its
    range by binary search. Without a number there are as many ranges as the session has
    shuffle partitions.
    """
    number = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [1 << i for i in range(max(1, number).bit_length() - 1, -1, -1)]
    place = F.struct(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)],
        *[c.alias(f"o{i}") for i, c in enumerate(order)],
    )
    drawn = df.select(place.alias("at")).orderBy(F.xxhash64("at")).limit(_SAMPLED * number)
    every = F.array_sort(F.collect_list("at"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(number)),
        lambda i: F.get("every", F.floor(i * F.size("every") / number).cast("int")),
    )
    bounds = drawn.agg(every.alias("every")).select(F.filter(cuts, lambda c: c.isNotNull()))
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            F.get("__bounds", at + step - 1) <= F.col("__place"), at + step
        ).otherwise(at),
    )
    placed = df.select("*", bounds.scalar().alias("__bounds"), place.alias("__place"))
    return placed.withColumn(_RANGE, found).drop("__bounds", "__place")


def _carried_first(order: Sequence[Column], descending: bool) -> list[Column]:
    """What earlier ranges left comes before the rows themselves."""
    own = [c.desc() if descending else c.asc() for c in order]
    return [F.col(_OWN).asc_nulls_first(), *own]


def ranged_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, tuple[Column, Sequence[str]]],
    ranges: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Adds ``sum(value) over (partition by by + within order by order rows unbounded preceding)``
    for each ``name: (value, within)``; ``order`` must be total within a key.

    What earlier ranges hold enters the window of a range as one row before all others, one
    for each (by, within) that comes again: there is no join, and rows move once, by
    (by, range).
    """
    rows = ranged(df, by, order, ranges)
    turn = F.col(_RANGE).desc() if descending else F.col(_RANGE).asc()
    values = {name: v.cast("bigint") for name, (v, _) in sums.items()}
    parts = [rows.select("*", F.lit(True).alias(_OWN), *[v.alias(n) for n, v in values.items()])]
    for within in dict.fromkeys(tuple(w) for _, w in sums.values()):
        mine = [name for name, (_, w) in sums.items() if tuple(w) == within]
        totals = rows.groupBy(*by, *within, _RANGE).agg(*[F.sum(values[n]).alias(n) for n in mine])
        earlier = (
            Window.partitionBy(*by, *within).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = totals.select(*by, *within, _RANGE, *[F.sum(n).over(earlier).alias(n) for n in mine])
        parts.append(carried.filter(F.coalesce(*mine).isNotNull()))
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    upto = (Window.unboundedPreceding, Window.currentRow)
    first = _carried_first(order, descending)
    summed = all_rows.select(
        *df.columns,
        _OWN,
        *[
            F.sum(name)
            .over(Window.partitionBy(*by, _RANGE, *within).orderBy(*first).rowsBetween(*upto))
            .alias(name)
            for name, (_, within) in sums.items()
        ],
    )
    return summed.filter(_OWN).drop(_OWN)


def ranged_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    ranges: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Adds ``row_number() over (partition by by order by order)``."""
    return ranged_sums(df, by, order, {name: (F.lit(1), ())}, ranges, descending)


def ranged_previous(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, Column],
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``lag(value) over (partition by by order by order)``."""
    rows = ranged(df, by, order, ranges).select(
        "*", F.lit(True).alias(_OWN), *[v.alias(f"__of_{name}") for name, v in values.items()]
    )
    held = F.struct(*[f"__of_{name}" for name in values])
    lasts = rows.groupBy(*by, _RANGE).agg(F.max_by(held, F.struct(*order)).alias("__last"))
    earlier = F.lag("__last").over(Window.partitionBy(*by).orderBy(_RANGE))
    carried = (
        lasts.select(*by, _RANGE, earlier.alias("__last"))
        .filter(F.col("__last").isNotNull())
        .select(*by, _RANGE, "__last.*")
    )
    inside = Window.partitionBy(*by, _RANGE).orderBy(*_carried_first(order, False))
    before = [F.lag(f"__of_{name}").over(inside).alias(name) for name in values]
    with_carried = rows.unionByName(carried, allowMissingColumns=True)
    return with_carried.select(*df.columns, _OWN, *before).filter(_OWN).drop(_OWN)


def complete_groups(
    batches: Iterator[pd.DataFrame], keys: Sequence[str]
) -> Iterator[pd.DataFrame]:
    """Regroups sorted batches so that no group of ``keys`` is split between two.

    For ``mapInPandas`` after ``repartition(keys).sortWithinPartitions(keys, ...)``:
    many small groups arrive in one frame, without a Python call per group. Only
    the group at the end of a batch is held back.
    """
    held = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        cut = group_bounds(batch, keys)[-1][0]
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        held = batch.iloc[cut:]
    if held is not None:
        yield held.reset_index(drop=True)


def group_bounds(frame: pd.DataFrame, keys: Sequence[str]) -> list[tuple[int, int]]:
    """Start and end row of each run of equal ``keys`` in a sorted frame; nulls are equal."""
    columns = frame[list(keys)]
    before = columns.shift()
    changed = (columns != before) & ~(columns.isna() & before.isna())
    starts = sorted({0, *changed.any(axis=1).to_numpy().nonzero()[0].tolist()})
    return list(zip(starts, [*starts[1:], len(frame)]))
