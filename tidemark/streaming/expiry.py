"""Expiry of leases in a stream: each lease is released once, when its end has passed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.times import as_utc, micros
from ..session import use_rocksdb_state

#: A lease's name (its id, or a hash of its fields if it has none) and what it holds.
_ID = ["named", "lease"]
_OUT = "named boolean, lease bigint, has_device boolean, device bigint, owner string, end_micros bigint"
_HELD = pa.schema(
    [
        ("named", pa.bool_()),
        ("lease", pa.int64()),
        ("has_device", pa.bool_()),
        ("device", pa.int64()),
        ("owner", pa.string()),
        ("end_micros", pa.int64()),
        ("end_ms", pa.int64()),
        ("closed", pa.bool_()),
    ]
)
_COLUMNS = _HELD.names[:6]


def _pack(leases: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(pa.Table.from_pandas(leases[_HELD.names], _HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


def _ids(leases: pd.DataFrame) -> list[tuple[bool, int]]:
    return list(zip(leases["named"].tolist(), leases["lease"].tolist()))


class Expire(StatefulProcessor):
    """A share of the leases, kept by the slot of time in which they end.

    A slot has a timer at its next end and is one value in state: leases that arrive
    together are stored together, and a timer touches the leases of its slot only. A lease
    that was released stays marked until its end; ``early`` has releases that found no lease.
    """

    def __init__(self, slot_ms: int):
        self.slot_ms = slot_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "slot bigint", "leases binary")
        self.early = handle.getMapState("early", "named boolean, lease bigint", "at_ms bigint")

    def _stored(self) -> Iterator[tuple[int, pd.DataFrame]]:
        for slot, leases in list(self.open.iterator()):
            yield slot[0], _unpack(leases[0])

    def _store(self, slot: int, leases: pd.DataFrame) -> None:
        self.open.updateValue((slot,), (_pack(leases),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A release before its lease's end closes it, whichever of the two comes first."""
        frame = pd.concat(list(rows), ignore_index=True)
        created = frame[frame["op"] == "create"].assign(closed=False)
        released = frame[(frame["op"] == "release") & frame["event_ms"].notna()]
        asked = released.groupby(_ID)["event_ms"].min().astype("int64").to_dict()
        first = dict(asked)
        if self.early.exists():
            for lease in {*_ids(created), *asked}:
                if self.early.containsKey(lease):
                    at = self.early.getValue(lease)[0]
                    first[lease] = min(at, first.get(lease, at))
        held = set()
        if first:
            self._close(created, first, held)
        if asked:
            for slot, leases in self._stored():
                if self._close(leases, asked, held):
                    self._store(slot, leases)
            for lease in asked:
                if lease not in held:
                    self.early.updateValue(lease, (first[lease],))
        for slot, leases in created.groupby(created["end_ms"] // self.slot_ms):
            ends = int(leases["end_ms"].min())
            stored = self.open.getValue((int(slot),))
            if stored is not None:
                before = _unpack(stored[0])
                known = int(before["end_ms"].min())
                leases = pd.concat([before, leases[_HELD.names]], ignore_index=True)
            else:
                known = None
            self._store(int(slot), leases)
            if known is None or ends < known:
                self.handle.registerTimer(ends)
        return iter([])

    def _close(self, leases: pd.DataFrame, first: dict, held: set) -> bool:
        """Marks the leases that were released before their end; notes which are held."""
        ids = _ids(leases)
        hit = np.array([lease in first for lease in ids], dtype=bool) & ~leases["closed"].to_numpy(bool)
        held.update(lease for lease, h in zip(ids, hit) if h)
        ends = leases["end_ms"].to_numpy()
        over = [k for k in np.flatnonzero(hit) if first[ids[k]] < ends[k]]
        if over:
            leases.iloc[over, leases.columns.get_loc("closed")] = True
        return bool(over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        slot = expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms
        stored = self.open.getValue((slot,))
        if stored is None:
            return
        leases = _unpack(stored[0])
        due = leases["end_ms"] <= now
        if due.all():
            self.open.removeKey((slot,))
        elif due.any():
            self._store(slot, leases[~due])
            self.handle.registerTimer(int(leases.loc[~due, "end_ms"].min()))
        if self.early.exists():
            self._forget({i for i in _ids(leases[due]) if self.early.containsKey(i)})
        done = leases[due & ~leases["closed"]]
        if len(done):
            yield done[_COLUMNS]

    def _forget(self, ended: set) -> None:
        """A release that came early goes with the last lease of its id."""
        if ended:
            for _, leases in self._stored():
                ended -= set(_ids(leases[~leases["closed"]]))
        for lease in ended:
            self.early.removeKey(lease)

    def close(self) -> None:
        pass


def expire_stream(
    leases: DataFrame, delay: str = "0 seconds", shares: int = 256, slot_seconds: int = 8 * 86_400
) -> DataFrame:
    """(lease_id, device_id, owner, expired_at) once the watermark of the starts passes an end.

    Leases are dealt by a hash of their id into ``shares``, and a share keeps those that end
    in the same ``slot_seconds`` as one value in state, with one timer: what a batch costs
    grows with the slots it touches and, per lease, with Arrow's work only. Slots are long, as
    a table of years has many: one that is due in part is stored once more in that batch. An optional ``op`` column
    (``create``/``release``, a release's time being
    its ``start_ts``) closes a lease early: a release before the end counts even if it arrives
    before its lease, one at or after the end does not. A lease that ends after the last
    start seen stays open. Rows without a lease id stand each for themselves.
    """
    use_rocksdb_state(leases.sparkSession)
    op = F.col("op") if "op" in leases.columns else F.lit("create")
    end_ms = F.call_function("div", micros("end_ts") + 999, F.lit(1000))
    alone = F.xxhash64("device_id", "owner", "start_ts", "end_ts")
    timed = (
        leases.filter((F.col("duration_s") > 0) & ((op != "create") | F.col("end_ts").isNotNull()))
        .select(
            F.col("lease_id").isNotNull().alias("named"),
            F.coalesce("lease_id", alone).cast("bigint").alias("lease"),
            F.col("device_id").isNotNull().alias("has_device"),
            F.coalesce("device_id", F.lit(0)).cast("bigint").alias("device"),
            "owner",
            op.alias("op"),
            F.coalesce(micros("end_ts"), F.lit(0)).alias("end_micros"),
            F.coalesce(end_ms, F.lit(0)).alias("end_ms"),
            F.call_function("div", micros("start_ts"), F.lit(1000)).alias("event_ms"),
            as_utc("start_ts").alias("event_time"),
        )
        .withColumn("share", F.pmod(F.xxhash64(*_ID), F.lit(shares)))
        .withWatermark("event_time", delay)
    )
    ended = timed.groupBy("share").transformWithStateInPandas(
        Expire(slot_seconds * 1000), _OUT, "append", "EventTime"
    )
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return ended.select(
        F.when(F.col("named"), F.col("lease")).alias("lease_id"),
        F.when(F.col("has_device"), F.col("device")).alias("device_id"),
        "owner",
        F.timestamp_add("MICROSECOND", "end_micros", epoch).alias("expired_at"),
    )
