"""Byte ledger per key: an allocation over the limit is refused and does not count."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import join_carried, ranged, ranged_sums, spread_by
from ..plans.scratch import written

_BLOCK, _HELD, _LEFT = "__block", "__held", "__left"

VERDICT = [T.StructField("ok", T.BooleanType()), T.StructField("usage", T.LongType())]


class Ledger:
    """Usage and live buffers of one key; shared by the batch and the stream form."""

    def __init__(self, usage: int = 0):
        self.usage = usage
        self.live = defaultdict(list)

    @classmethod
    def holding(cls, held: Iterable[dict]) -> Ledger:
        """A ledger that starts with live buffers, as ``held`` gives them."""
        ledger = cls()
        for row in held:
            ledger.live[row["buffer_id"]].append(row["size"])
            ledger.usage += row["size"]
        return ledger

    def held(self) -> list[dict]:
        """The live buffers in the order of their ids: equal for ledgers that go on alike."""
        ids = sorted(self.live, key=lambda b: (b is not None, b))
        return [{"buffer_id": b, "size": size} for b in ids for size in self.live[b]]

    def apply(self, op: str, buffer_id, size: int | None, limit: int | None) -> bool:
        if op == "track":
            if limit is None or size is None or self.usage + size > limit:
                return False
            self.live[buffer_id].append(size)
            self.usage += size
            return True
        held = self.live.get(buffer_id)
        if not held:
            return False
        self.usage -= held.pop(0)
        if not held:
            del self.live[buffer_id]
        return True

    def apply_all(self, rows: Iterable[tuple]) -> tuple[list[bool], list[int]]:
        """Verdict and usage after each (op, buffer_id, size, limit)."""
        ok, usage = [], []
        for row in rows:
            ok.append(self.apply(*row))
            usage.append(self.usage)
        return ok, usage


def _matched(ops: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Verdict and change of usage as if every allocation fitted, in one shuffle.

    With all allocations accepted, a release counts if it is the first one after its
    buffer was tracked. Rows are told as odd where that is not enough: a buffer tracked
    twice, an allocation without size or limit. Without a buffer id nothing can match;
    such rows stand alone, so that they never meet in one group.
    """
    at = F.struct(*order)
    is_track, named = F.col("op") == "track", F.col("buffer_id").isNotNull()
    alone = F.when(~named, F.xxhash64(*order))
    buffer = Window.partitionBy(key, "buffer_id", "__alone")
    tracked = (
        ops.withColumn("__alone", alone)
        .withColumn("__tracked", F.min(F.when(is_track, at)).over(buffer))
        .withColumn("__held", F.max(F.when(is_track, F.col("size"))).over(buffer))
        .withColumn("__tracks", F.count_if(is_track).over(buffer))
    )
    late = ~is_track & (at > F.col("__tracked"))
    freed = tracked.withColumn("__freed", F.min(F.when(late, at)).over(buffer))
    ok = named & F.coalesce(is_track | (at == F.col("__freed")), F.lit(False))
    delta = (
        F.when(~named, F.lit(0))
        .when(is_track, F.col("size"))
        .when(F.col("ok"), -F.col("__held"))
        .otherwise(F.lit(0))
    )
    odd = (
        (F.col("__tracks") > 1)
        | F.col("__delta").isNull()
        | (is_track & (F.col("limit_bytes").isNull() | ~named))
    )
    return (
        freed.withColumn("ok", ok)
        .withColumn("__delta", delta.cast("bigint"))
        .withColumn("__odd", F.coalesce(odd, F.lit(True)))
        .select(*ops.columns, "ok", "__delta", "__odd")
    )


def _folded(
    batches: Iterator[pa.RecordBatch], key: str
) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with (key, block, buffers if the row starts it, ledger, verdict, usage) of its rows.

    Rows come block by block. A block starts empty, or from the buffers in a row of its own
    that comes before its operations and has no verdict.
    """
    at, ledger = object(), Ledger()
    for batch in batches:
        columns = [
            batch.column(c).to_pylist()
            for c in (key, _BLOCK, _HELD, "op", "buffer_id", "size", "limit_bytes")
        ]
        done = []
        for k, block, held, *row in zip(*columns):
            if (k, block) != at:
                at, ledger = (k, block), Ledger()
            if held is not None:
                ledger = Ledger.holding(held)
            ok = None if held is not None else ledger.apply(*row)
            done.append((k, block, held, ledger, ok, ledger.usage))
        yield batch, done


def _buffers(ops: DataFrame) -> T.ArrayType:
    return T.ArrayType(T.StructType([ops.schema[c] for c in ("buffer_id", "size")]))


def _by_block(rows: DataFrame, starts: DataFrame | None, key: str, order: Sequence[str]) -> DataFrame:
    """Rows in order, block by block, each block behind the row of ``starts`` with its buffers."""
    every = rows.withColumn(_HELD, F.lit(None).cast(_buffers(rows)))
    if starts is not None:
        every = every.unionByName(starts.select(key, _BLOCK, _HELD), allowMissingColumns=True)
    return spread_by(every, key, _BLOCK).sortWithinPartitions(
        key, _BLOCK, F.col(_HELD).isNull(), *order
    )


def _ends(rows: DataFrame, starts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, block, buffers held before it, buffers held after it) of the blocks in ``starts``."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, came, ledger, schema = None, None, None, None

        def row():
            types = [schema.field(c).type for c in (key, _BLOCK, _HELD, _HELD)]
            values = [at[0], at[1], came, ledger.held()]
            arrays = [pa.array([v], t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(arrays, names=[key, _BLOCK, _HELD, _LEFT])

        for batch, done in _folded(batches, key):
            schema = batch.schema
            for k, block, held, of_block, *_ in done:
                if held is not None:
                    if at is not None:
                        yield row()
                    at, came, ledger = (k, block), held, of_block
        if at is not None:
            yield row()

    mine = join_carried(rows, starts.select(key, _BLOCK, F.lit(True).alias("__asked")), [key, _BLOCK])
    sorted_rows = _by_block(mine.filter("__asked").drop("__asked"), starts, key, order)
    of_block = [sorted_rows.schema[c] for c in (key, _BLOCK, _HELD)]
    out = T.StructType([*of_block, T.StructField(_LEFT, of_block[-1].dataType)])
    return sorted_rows.mapInArrow(ends, out)


def _seams(rows: DataFrame, key: str, order: Sequence[str], rounds: int) -> DataFrame:
    """For each block its true first buffers and the block it is read with (``__with``).

    All blocks are run at once as if nothing was held before them; then a block's buffers
    at its start are compared with what the block before it left, and those that differ are
    run again, until none does. A block that is right stays so, and in each round at least
    one more becomes right. Where buffers live shorter than a block, one round is enough; what
    still differs after ``rounds`` rounds is read in order with the first block of the key that
    differs, whose own start is right by then.
    """
    by_key = Window.partitionBy(key)
    blocks = rows.select(key, _BLOCK).distinct()
    blocks = blocks.withColumn("__before", F.lag(_BLOCK).over(by_key.orderBy(_BLOCK)))
    blocks = written(blocks.withColumn("__last", F.lead(_BLOCK).over(by_key.orderBy(_BLOCK)).isNull()), "blocks")
    nothing = F.array().cast(_buffers(rows))
    leaving = blocks.filter(~F.col("__last")).select(key, _BLOCK, nothing.alias(_HELD))
    ends = written(_ends(rows, leaving, key, order), "ends")
    for done in range(rounds + 1):
        left = ends.select(key, F.col(_BLOCK).alias("__before"), F.col(_LEFT).alias("__came"))
        seams = join_carried(blocks, left, [key, "__before"])
        seams = seams.withColumn("__came", F.coalesce("__came", nothing))
        seams = join_carried(seams, ends, [key, _BLOCK])
        differs = ~F.col("__last") & ~F.col(_HELD).eqNullSafe(F.col("__came"))
        seams = written(seams.withColumn("__differs", differs), "seams")
        if done == rounds or seams.filter("__differs").isEmpty():
            break
        again = seams.filter("__differs").select(key, _BLOCK, F.col("__came").alias(_HELD))
        same = seams.filter(~F.col("__differs") & ~F.col("__last")).select(key, _BLOCK, _HELD, _LEFT)
        ends = written(same.unionByName(_ends(rows, again, key, order)), "ends")
    first = F.min(F.when(F.col("__differs"), F.col(_BLOCK))).over(by_key)
    return seams.select(
        key, _BLOCK, F.col("__came").alias(_HELD), F.least(_BLOCK, first).alias("__with")
    )


def quota_fold(
    ops: DataFrame,
    key: str = "key",
    order: Sequence[str] = ("ts", "event_id"),
    ranges: int | None = None,
    block_rows: int = 200_000,
    rounds: int = 4,
) -> DataFrame:
    """Adds ``ok`` (accepted, or released) and ``usage`` after each operation.

    First all keys are summed in parallel, as if every allocation fitted. Real usage is
    never above that sum: where it stays within the limit for a whole key, it is the
    answer. In a key that does reach its limit a verdict depends on all earlier ones: its
    log is cut into blocks of about ``block_rows`` rows that are run at once from guessed
    buffers and again where the guess was wrong, ``rounds`` times at most; what is open
    then is read in order. A task holds the live buffers of a block and never its log.
    ``order`` starts with a TIMESTAMP_NTZ and is total within a key. ``ops`` is read once;
    what is read again are tables in the shared folder. A null key is a key of its own.
    """

    names = ops.columns

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, done in _folded(batches, key):
            ok, usage = pa.array([d[-2] for d in done], pa.bool_()), pa.array([d[-1] for d in done], pa.int64())
            rows = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], ok, usage], names=[*names, "ok", "usage"]
            )
            yield rows.filter(ok.is_valid())

    out = T.StructType([*ops.schema.fields, *VERDICT])
    matched = written(_matched(ops, key, order), "matched")
    change = F.coalesce("__delta", F.lit(0))
    at = [F.col(c) for c in order]
    summed = ranged_sums(matched, [key], at, {"usage": (change, ())}, ranges)
    summed = written(summed, "usage")
    full = F.col("__odd") | ((F.col("op") == "track") & (F.col("usage") > F.col("limit_bytes")))
    reached = summed.filter(full).select(F.col(key).alias("__key")).distinct()
    is_reached = F.col(key).eqNullSafe(F.col("__key"))
    parallel = summed.join(reached, is_reached, "left_anti").select(*ops.columns, "ok", "usage")
    ordered = summed.join(reached, is_reached, "left_semi").select(*ops.columns)
    blocks = -(-ordered.count() // block_rows)
    if blocks > 1:
        cut = written(ranged(ordered, [key], at, blocks).withColumnRenamed("__range", _BLOCK), "log")
        seams = _seams(cut, key, order, rounds)
        dealt = join_carried(cut, seams.select(key, _BLOCK, "__with"), [key, _BLOCK])
        rows = dealt.withColumn(_BLOCK, F.col("__with")).drop("__with")
        starts = seams.filter(F.col(_BLOCK) == F.col("__with"))
        in_order = _by_block(rows, starts, key, order)
    else:
        in_order = _by_block(ordered.withColumn(_BLOCK, F.lit(0)), None, key, order)
    return parallel.unionByName(in_order.mapInArrow(verdicts, out))
