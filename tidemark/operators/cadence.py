"""Which steps of a job save a checkpoint: every N steps, or S seconds after the last save.

A save of either kind restarts the clock, so a decision depends on earlier ones.
A job's log is cut into blocks of steps. What a block does to the clock is a small
step function (time of the last save going in -> coming out), and a block with a
step-save forgets what came in. Such functions compose, so they are scanned as a tree; with
the incoming clock known, all blocks are decided independently.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import micros
from ..plans.ordered import complete_groups, group_bounds, join_carried, spread_by
from ..plans.scratch import written


def next_by_time(t: np.ndarray, wait: int) -> np.ndarray:
    """For each row the first later row at least ``wait`` after it, or len(t)."""
    if len(t) < 2 or (np.diff(t) >= 0).all():
        return np.searchsorted(t, t + wait, side="left")
    late = [np.flatnonzero(t[i + 1 :] >= t[i] + wait) for i in range(len(t))]
    return np.array([i + 1 + hits[0] if len(hits) else len(t) for i, hits in enumerate(late)])


def walk(t: np.ndarray, by_step: np.ndarray, wait: int, last: int) -> tuple[np.ndarray, int]:
    """Save flags of one block whose last earlier save was at ``last``, and the new last."""
    saved = np.zeros(len(t), dtype=bool)
    step_rows = np.flatnonzero(by_step)
    rising = len(t) < 2 or bool((np.diff(t) >= 0).all())
    at = 0
    while at < len(t):
        if rising:
            by_time = max(at, int(np.searchsorted(t, last + wait, side="left")))
        else:
            due = np.flatnonzero(t[at:] >= last + wait)
            by_time = at + due[0] if len(due) else len(t)
        nth = np.searchsorted(step_rows, at)
        row = min(by_time, step_rows[nth] if nth < len(step_rows) else len(t))
        if row == len(t):
            break
        saved[row] = True
        last = int(t[row])
        at = row + 1
    return saved, last


def clock_function(t: np.ndarray, by_step: np.ndarray, wait: int) -> list[tuple[int | None, int]]:
    """The block's effect on the clock as (highest incoming value, outgoing value) pairs.

    ``None`` stands for any incoming value. An incoming value above all pairs
    passes unchanged: nothing in the block was due.
    """
    first = np.flatnonzero(by_step)
    if len(first):
        start = int(first[0])
        _, last = walk(t[start + 1 :], by_step[start + 1 :], wait, int(t[start]))
        return [(None, last)]
    following = next_by_time(t, wait)
    out = t.copy()
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            out[i] = out[following[i]]
    peaks = np.maximum.accumulate(t)
    records = np.flatnonzero(np.concatenate(([True], peaks[1:] > peaks[:-1])))
    pairs: list[tuple[int | None, int]] = []
    for i in records:
        if pairs and pairs[-1][1] == int(out[i]):
            pairs.pop()
        pairs.append((int(t[i]) - wait, int(out[i])))
    return pairs


#: Stands for any incoming clock.
_ANY = -(2**63)


def apply_clock(pairs: list[tuple[int | None, int]], last: int) -> int:
    """The clock after a block that it enters as ``last``."""
    low, high = 0, len(pairs)
    while low < high:
        middle = (low + high) // 2
        upto = pairs[middle][0]
        if upto is None or last <= upto:
            high = middle
        else:
            low = middle + 1
    return pairs[low][1] if low < len(pairs) else last


def composed(
    first: list[tuple[int | None, int]], second: list[tuple[int | None, int]], bound: int
) -> list[tuple[int | None, int]]:
    """What two blocks in a row do to clocks up to ``bound``: one function of the same form."""
    pairs: list[tuple[int | None, int]] = []
    for upto, out in [*((u, apply_clock(second, o)) for u, o in first), *second]:
        if pairs and (pairs[-1][0] is None or (upto is not None and upto <= pairs[-1][0])):
            continue  # the first block has taken these
        if pairs and pairs[-1][1] == out:
            pairs.pop()
        pairs.append((upto, out))
        if upto is None or upto >= bound:
            break  # no clock comes in above the bound
    return pairs


def _incoming_bounds(level: DataFrame, key: str, parent: Column) -> DataFrame:
    """Adds ``__bound``: no clock that enters a block is above it.

    That is the latest time of all blocks before it, and for the first block its first time.
    """
    held = level.withColumn("__parent", parent)
    peaks = held.groupBy(key, "__parent").agg(F.max("__peak").alias("__peak"))
    before = Window.partitionBy(key).orderBy("__parent").rowsBetween(Window.unboundedPreceding, -1)
    earlier = peaks.select(key, "__parent", F.max("__peak").over(before).alias("__earlier"))
    inside = (
        Window.partitionBy(key, "__parent").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    )
    near = held.withColumn("__near", F.max("__peak").over(inside))
    bound = F.greatest("__earlier", "__near", "__first")
    joined = join_carried(near, earlier, [key, "__parent"]).withColumn("__bound", bound)
    return joined.drop("__parent", "__near", "__earlier")


def _columns(pairs: list[tuple[int | None, int]]) -> tuple[list[int], list[int]]:
    return [_ANY if u is None else u for u, _ in pairs], [o for _, o in pairs]


def _pairs(upto: Iterable[int], out: Iterable[int]) -> list[tuple[int | None, int]]:
    return [(None if u == _ANY else int(u), int(o)) for u, o in zip(upto, out)]


def checkpoint_cadence(
    log: DataFrame,
    every_steps: int | None = 100,
    every_seconds: int | None = None,
    key: str = "job_id",
    tie: str = "event_id",
    block: int = 4096,
    fan_in: int = 64,
) -> DataFrame:
    """Adds ``saved`` to a step log (key, step, ts, tie).

    The functions of ``fan_in`` neighbouring blocks are composed into one, round after round,
    until a job has few; the clocks are then handed down the same tree. So no task sees all
    blocks of a job. The clock starts at the job's first row. ``None`` switches a rule off. A row without
    step or time is not saved and does not move the clock; a null job is a job.
    """
    by_step = F.lit(False)
    if every_steps:
        by_step = (F.col("step") > 0) & (F.col("step") % every_steps == 0)
    by_step = F.coalesce(by_step, F.lit(False))
    if not every_seconds:
        return log.withColumn("saved", by_step)

    wait = every_seconds * 1_000_000
    rows = log.withColumns(
        {
            "__t": F.coalesce(micros("ts"), F.lit(0)),
            "__by_step": by_step,
            "__block": F.coalesce(F.floor(F.col("step") / block), F.lit(-1)),
            "__timed": F.col("ts").isNotNull() & F.col("step").isNotNull(),
        }
    )
    columns = log.columns
    block_key = [key, "__block"]
    key_field = log.schema[key]

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(batches, block_key):
            t, flags = frame["__t"].to_numpy(), frame["__by_step"].to_numpy()
            jobs, blocks = frame[key].to_numpy(), frame["__block"].to_numpy()
            found = [
                (
                    jobs[a], blocks[a], t[a], t[a:b].max(),
                    *_columns(clock_function(t[a:b], flags[a:b], wait)),
                )
                for a, b in group_bounds(frame, block_key)
            ]
            yield pd.DataFrame(found, columns=function_schema.names)

    block_field = T.StructField("__block", T.LongType())
    longs = T.ArrayType(T.LongType())
    function_schema = T.StructType(
        [
            key_field,
            block_field,
            T.StructField("__first", T.LongType()),
            T.StructField("__peak", T.LongType()),
            T.StructField("__upto", longs),
            T.StructField("__out", longs),
        ]
    )
    parent = F.floor(F.col("__block") / fan_in)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(batches, [key, "__parent"]):
            found = []
            for a, b in group_bounds(frame, [key, "__parent"]):
                part = frame.iloc[a:b]
                bound = int(part["__bound"].iloc[0])
                whole = reduce(
                    lambda x, y: composed(x, y, bound),  # noqa: B023
                    map(_pairs, part["__upto"], part["__out"]),
                )
                head = [part[c].iloc[0] for c in (key, "__parent", "__first")]
                found.append((*head, part["__peak"].max(), *_columns(whole)))
            yield pd.DataFrame(found, columns=function_schema.names)

    def hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(batches, [key, "__parent"]):
            entries = []
            for a, b in group_bounds(frame, [key, "__parent"]):
                part = frame.iloc[a:b]
                last = part["__last"].iloc[0]
                last = int(part["__first"].iloc[0] if pd.isna(last) else last)
                for block, upto, out in zip(part["__block"], part["__upto"], part["__out"]):
                    entries.append((part[key].iloc[0], block, last))
                    last = apply_clock(_pairs(upto, out), last)
            yield pd.DataFrame(entries, columns=[key, "__block", "__last"])

    chain_schema = T.StructType([key_field, block_field, T.StructField("__last", T.LongType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(batches, block_key):
            saved = np.zeros(len(frame), dtype=bool)
            timed = frame[frame["__timed"]]
            places = np.flatnonzero(frame["__timed"].to_numpy())
            t, flags = timed["__t"].to_numpy(), timed["__by_step"].to_numpy()
            last = timed["__last"].to_numpy()
            for a, b in group_bounds(timed, block_key) if len(timed) else ():
                saved[places[a:b]] = walk(t[a:b], flags[a:b], wait, int(last[a]))[0]
            yield frame[columns].assign(saved=saved)

    in_order = [*block_key, "step", "__t", tie]
    timed_rows = rows.filter("__timed")
    steps = timed_rows.select(*dict.fromkeys([key, "step", tie]), "__t", "__by_step", "__block")
    functions_of_blocks = (
        spread_by(steps, *block_key).sortWithinPartitions(*in_order).mapInPandas(functions, function_schema)
    )
    levels = [written(functions_of_blocks, "clocks")]
    while (levels[-1].agg(F.max(F.abs("__block"))).first()[0] or 0) >= fan_in:
        bounded = _incoming_bounds(levels[-1], key, parent)
        held = bounded.withColumn("__parent", parent)
        grouped = spread_by(held, key, "__parent").sortWithinPartitions(key, "__parent", "__block")
        levels.append(written(grouped.mapInPandas(compose, function_schema), "clocks"))
    # the top has at most 2 * fan_in blocks a job; its clock starts at the job's first row
    clocks = levels[-1].select(key, F.lit(None).cast("bigint").alias("__parent")).distinct()
    clocks = clocks.withColumn("__last", F.lit(None).cast("bigint"))
    for number, level in reversed(list(enumerate(levels))):
        above = parent if number < len(levels) - 1 else F.lit(None).cast("bigint")
        known = join_carried(level.withColumn("__parent", above), clocks, [key, "__parent"])
        down = spread_by(known, key, "__parent").sortWithinPartitions(key, "__parent", "__block")
        clocks = down.mapInPandas(hand_down, chain_schema)
        if number:
            clocks = written(clocks, "handed").withColumnRenamed("__block", "__parent")
    saved_schema = T.StructType([*log.schema.fields, T.StructField("saved", T.BooleanType())])
    return (
        spread_by(join_carried(rows, clocks, block_key), *block_key)
        .sortWithinPartitions(*in_order)
        .mapInPandas(decide, saved_schema)
    )
