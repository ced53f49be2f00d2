"""Stream forms of the sequential operators: save cadence and byte ledger."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.times import micros
from ..operators.cadence import walk
from ..operators.quota import VERDICT, Ledger
from ..session import use_rocksdb_state


def _part_of(buffer_id: str, parts: int) -> int:
    return zlib.crc32(buffer_id.encode()) % parts


def _whole(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's frames as one; most keys have one."""
    frames = list(rows)
    return frames[0].reset_index(drop=True) if len(frames) == 1 else pd.concat(frames, ignore_index=True)


class _Cadence(StatefulProcessor):
    def __init__(self, every_steps: int | None, wait: int | None, columns: Sequence[str], tie: str):
        self.every_steps, self.wait = every_steps, wait
        self.columns, self.tie = list(columns), tie

    def init(self, handle) -> None:
        self.clock = handle.getValueState("clock", "last bigint, step bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _whole(rows)
        known = (frame["step"].notna() & frame["at_micros"].notna()).to_numpy()
        if not known.all():
            yield frame.loc[~known, self.columns].assign(saved=False)
            frame = frame[known]
        if not len(frame):
            return
        frame = frame.sort_values(["step", "at_micros", self.tie])
        t, step = frame["at_micros"].astype("int64").to_numpy(), frame["step"].astype("int64").to_numpy()
        flags = np.zeros(len(t), dtype=bool)
        if self.every_steps:
            flags = (step > 0) & (step % self.every_steps == 0)
        last, before = self.clock.get() or (int(t[0]), None)
        if before is not None and int(step[0]) < before:
            raise ValueError(f"{key}: step {step[0]} arrived after step {before}")
        never = np.iinfo(np.int64).max // 4
        saved, last = walk(t, flags, self.wait or never, last)
        self.clock.update((int(last), int(step[-1])))
        yield frame[self.columns].assign(saved=saved)

    def close(self) -> None:
        pass


def checkpoint_cadence_stream(
    log: DataFrame,
    every_steps: int | None = 100,
    every_seconds: int | None = None,
    key: str = "job_id",
    tie: str = "event_id",
) -> DataFrame:
    """Adds ``saved``; a job's rows must arrive in step order from batch to batch.

    The last step is kept in state, and a row of an earlier step ends the stream. As in the
    batch form, a row without step or time is not saved and does not move the clock.
    """
    use_rocksdb_state(log.sparkSession)
    rows = log.withColumn("at_micros", micros("ts"))
    out = T.StructType([*log.schema.fields, T.StructField("saved", T.BooleanType())])
    wait = every_seconds * 1_000_000 if every_seconds else None
    return rows.groupBy(key).transformWithStateInPandas(
        _Cadence(every_steps, wait, log.columns, tie), out, "append", "None"
    )


#: Live buffers that a part of a key's state holds on average before there are twice as many parts.
_PART_HOLDS = 256


class _Quota(StatefulProcessor):
    """Usage and last time of a key, and its live buffers in parts by a hash of their ids.

    A part is one value, so that a key with few buffers costs one read and one write for a
    batch; a key with many has many parts, of which a batch touches those of its buffers.
    """

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle) -> None:
        self.usage = handle.getValueState("usage", "usage bigint, at bigint, parts bigint, held bigint")
        self.live = handle.getMapState("live", "part bigint", "sizes string")

    def _read(self, part: int) -> dict[str, list[int]]:
        found = self.live.getValue((part,))
        return json.loads(found[0]) if found else {}

    def _write(self, part: int, sizes: dict[str, list[int]], was: bool) -> None:
        if sizes:
            self.live.updateValue((part,), (json.dumps(sizes),))
        elif was:
            self.live.removeKey((part,))

    def _split(self, parts: int, held: int) -> int:
        """Deals all live buffers into so many parts that they are half full."""
        stored = {part: self._read(part) for part in range(parts)}
        more = parts
        while held > more * _PART_HOLDS // 2:
            more *= 2
        dealt = defaultdict(dict)
        for sizes in stored.values():
            for buffer_id, held_sizes in sizes.items():
                dealt[_part_of(buffer_id, more)][buffer_id] = held_sizes
        for part in range(more):
            self._write(part, dealt[part], bool(stored.get(part)))
        return more

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _whole(rows).sort_values(self.order)
        known = self.usage.get()
        usage, before, parts, held = known or (0, None, 1, 0)
        if before is not None and int(frame["at_micros"].iloc[0]) < before:
            raise ValueError(f"{key}: an operation arrived after a later one")
        ledger = Ledger(usage)
        touched = defaultdict(list)
        for buffer_id in frame["buffer_id"].unique():
            if buffer_id is not None:
                touched[_part_of(buffer_id, parts)].append(buffer_id)
        stored = {part: self._read(part) if held else {} for part in touched}
        for part, ids in touched.items():
            ledger.live.update((b, list(stored[part][b])) for b in ids if b in stored[part])
        limits = [None if v < 0 else v for v in frame["limit_or_minus"].tolist()]
        ok, usage = ledger.apply_all(
            zip(frame["op"], frame["buffer_id"], frame["size"].tolist(), limits)
        )
        for part, ids in touched.items():
            sizes = dict(stored[part])
            for buffer_id in ids:
                sizes.pop(buffer_id, None)
                if ledger.live.get(buffer_id):
                    sizes[buffer_id] = ledger.live[buffer_id]
            if sizes != stored[part]:
                self._write(part, sizes, bool(stored[part]))
            held += len(sizes) - len(stored[part])
        if held > parts * _PART_HOLDS:
            parts = self._split(parts, held)
        self.usage.update((ledger.usage, int(frame["at_micros"].iloc[-1]), parts, held))
        yield frame.drop(columns=["limit_or_minus", "at_micros"]).assign(ok=ok, usage=usage)

    def close(self) -> None:
        pass


def quota_stream(
    ops: DataFrame, key: str = "key", order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """(key, order, op, buffer_id, size, ok, usage) per operation.

    A key's operations must arrive in order from batch to batch; one that is earlier
    than what came before ends the stream. Operations without a buffer id match nothing.
    Buffer ids travel as text: pandas would turn a nullable whole number into a float.
    """
    use_rocksdb_state(ops.sparkSession)
    rows = ops.select(
        key,
        *order,
        "op",
        F.col("buffer_id").cast("string").alias("buffer_id"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("limit_bytes", F.lit(-1)).cast("bigint").alias("limit_or_minus"),
        micros(order[0]).alias("at_micros"),
    )
    out = T.StructType([*rows.schema.fields[:-2], *VERDICT])
    folded = rows.groupBy(key).transformWithStateInPandas(_Quota(order), out, "append", "None")
    return folded.withColumn("buffer_id", F.col("buffer_id").cast(ops.schema["buffer_id"].dataType))
