"""What a query does once for each row, key or slot of time, where it did it more often before."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import inference, scoring
from tidemark.operators import ngrams as ng
from tidemark.operators.quota import Ledger
from tidemark.streaming import expiry, stateful

TEXTS = [(1, "a b a c."), (2, ""), (3, None), (4, "a b"), (5, "b a b a b")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class State:
    """Value, map and timer of a stateful key in memory; counts the calls."""

    def __init__(self):
        self.values, self.maps, self.calls, self.timers = {}, {}, 0, []

    def getValueState(self, name, schema):
        return Value(self, self.values, name)

    def getMapState(self, name, key, value):
        return Map(self, self.maps.setdefault(name, {}))

    def registerTimer(self, at):
        self.timers.append(at)


class Value:
    def __init__(self, state, values, name):
        self.state, self.values, self.name = state, values, name

    def exists(self):
        self.state.calls += 1
        return self.name in self.values

    def get(self):
        self.state.calls += 1
        return self.values.get(self.name)

    def update(self, value):
        self.state.calls += 1
        self.values[self.name] = value


class Map:
    def __init__(self, state, entries):
        self.state, self.entries = state, entries

    def exists(self):
        self.state.calls += 1
        return bool(self.entries)

    def containsKey(self, key):
        self.state.calls += 1
        return key in self.entries

    def getValue(self, key):
        self.state.calls += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.state.calls += 1
        self.entries[key] = value

    def removeKey(self, key):
        self.state.calls += 1
        del self.entries[key]

    def iterator(self):
        self.state.calls += 1
        return iter(list(self.entries.items()))


def ops(first, n, op="track", limit=10**9):
    ids = range(first, first + n)
    return pd.DataFrame(
        {
            "key": 1,
            "ts": pd.Timestamp("2024-01-01"),
            "event_id": list(ids),
            "op": op,
            "buffer_id": [str(i % 5000) for i in ids],
            "size": [i % 7 for i in ids],
            "limit_or_minus": limit,
            "at_micros": 0 if op == "track" else 1,
        }
    )


def quota(state):
    processor = stateful._Quota(["ts", "event_id"])
    processor.init(state)
    return processor


def test_quota_state_is_read_in_parts():
    state = State()
    processor = quota(state)
    list(processor.handleInputRows((1,), iter([ops(0, 40)]), None))
    state.calls = 0
    list(processor.handleInputRows((1,), iter([ops(40, 40)]), None))
    assert state.calls <= 4


def test_quota_parts_grow_with_a_key():
    state, ledger = State(), Ledger()
    processor = quota(state)
    batches = [ops(0, 3000), ops(3000, 4000), ops(100, 2500, "release"), ops(100, 2500, "release"), ops(0, 7000, "release")]
    for batch in batches:
        got = pd.concat(processor.handleInputRows((1,), iter([batch]), None))
        rows = zip(batch["op"], batch["buffer_id"], batch["size"].tolist(), batch["limit_or_minus"].tolist())
        ok, usage = ledger.apply_all(rows)
        assert got["ok"].tolist() == ok and got["usage"].tolist() == usage
    assert state.values["usage"][2] > 8 and state.values["usage"][3] == len(ledger.live) == 0
    assert not state.maps["live"]


def test_cadence_state_is_read_once():
    state = State()
    processor = stateful._Cadence(10, None, ["job_id", "event_id", "step"], "event_id")
    processor.init(state)
    rows = pd.DataFrame({"job_id": 1, "event_id": range(20), "step": range(1, 21), "at_micros": range(20)})
    got = pd.concat(processor.handleInputRows((1,), iter([rows]), None))
    assert got["saved"].sum() == 2 and state.calls == 2


def test_expiry_slots_of_a_long_time(spark):
    """Leases over 64 days: the state of a share is a few values, not one a day."""
    state, seen = State(), []
    day = 86_400_000
    expiry_of = {}
    real = expiry.Expire
    expiry.Expire = lambda slot_ms: expiry_of.setdefault("slot_ms", slot_ms) and real(slot_ms)
    try:
        stream = spark.readStream.format("rate").load()
        stamp = F.col("timestamp").cast("timestamp_ntz")
        leases = stream.select(
            F.col("value").alias("lease_id"),
            F.lit(1).alias("device_id"),
            F.lit("a").alias("owner"),
            F.lit(5).alias("duration_s"),
            stamp.alias("start_ts"),
            stamp.alias("end_ts"),
        )
        expiry.expire_stream(leases)
    finally:
        expiry.Expire = real
    processor = expiry.Expire(expiry_of["slot_ms"])
    processor.init(state)
    ends = [d * day + 5 for d in range(64)]
    frame = pd.DataFrame(
        {
            "named": True, "lease": range(64), "has_device": True, "device": 1, "owner": "a", "op": "create",
            "end_micros": [e * 1000 for e in ends], "end_ms": ends, "event_ms": 0,
        }
    )
    list(processor.handleInputRows((1,), iter([frame]), None))
    assert len(state.maps["open"]) <= 9
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 70 * day})()
    for at in state.timers:
        expired = type("At", (), {"getExpiryTimeInMs": lambda self, at=at: at})()
        seen += [i for part in processor.handleExpiredTimer((1,), now, expired) for i in part["lease"]]
    assert sorted(seen) == list(range(64)) and not state.maps["open"]


def test_grams_are_cut_once(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string").repartition(2)
    for rows in (ng.explode_ngrams(docs, "id", "text", 2), ng.explode_tokens(docs, "id", "text")):
        assert plan_of(rows).count("regexp_extract_all") == 1
    grams = ng.explode_ngrams(docs, "id", "text", 2).collect()
    assert sorted((r["id"], r["pos"], *r["gram"]) for r in grams) == sorted(
        [(1, 0, "a", "b"), (1, 1, "b", "a"), (1, 2, "a", "c"), (1, 3, "c", "."), (4, 0, "a", "b")]
        + [(5, i, *("ba", "ab")[i % 2]) for i in range(4)]
    )
    assert ng.explode_ngrams(docs, "id", "text", 0).count() == 0


def test_vectors_are_worked_out_once(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string").repartition(2)
    vectors = inference.embed_column(docs, dim=16)
    rows = vectors.select("id", F.posexplode("embedding").alias("place", "x")).filter("x <> 0")
    assert plan_of(rows).count("regexp_extract_all") == 1
    by_id = {r["id"]: r["embedding"] for r in vectors.collect()}
    assert all(len(v) == 16 for v in by_id.values()) and not any(by_id[2]) and not any(by_id[3])
    assert abs(sum(x * x for x in by_id[1]) - 1) < 1e-6


def test_texts_are_cut_once_for_perplexity(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string")
    assert "regexp_extract_all" not in plan_of(scoring.bigram_perplexity(docs, "id", "text"))
