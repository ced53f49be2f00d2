"""Neighbours, secrets, toxicity and the pipeline against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from odd import empty, exact_groups, mixture, near_classes, odd, odd_rows, table_rows

from tidemark.llm import neighbours, secrets, toxicity
from tidemark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_nearest(rows: list[tuple], wanted, k: int) -> dict:
    """query id -> ids and distances of the nearest, every pair compared in double precision."""
    use = {}
    for vec_id, v, *_ in rows:
        if vec_id is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        use.setdefault(vec_id, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in filter(wanted, use):
        a = min(map(tuple, use[q]))
        near = {}
        for c, vs in use.items():
            for v in vs:
                if c != q and len(v) == len(a):
                    total = 0.0
                    for x, y in zip(a, v):
                        total += (x - y) * (x - y)
                    near[c] = min(near.get(c, np.inf), float(np.sqrt(total)))
        if near:
            out[q] = sorted((s, c) for c, s in near.items())[:k]
    return out


def as_lists(found) -> dict:
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_of_the_table(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [tuple(r) for r in vectors.collect()]
    want = brute_nearest(rows, lambda i: i % 100 == 0, 10)
    assert as_lists(QUERIES["op6_neighbours"](spark, SMALL)) == want
    some = vectors.filter("vec_id % 7 = 0")
    assert as_lists(neighbours.nearest(vectors, some, k=3, block_rows=9)) == brute_nearest(
        rows, lambda i: i % 7 == 0, 3
    )


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.5], 0),
        (3, [1.0, 2.0, 2.5], 0), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [nan, 1.0, 1.0], 0),
        (7, [inf, 1.0, 1.0], 0), (8, [1.0, None, 2.0], 0), (9, [], 0), (10, [1.0, 2.0], 0),
        (11, [3.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0), (12, [9.0, 9.0, 9.0], 0),
        (12, [1.0, 2.0, 3.1], 0), (13, [1e30, 1.0, 1.0], 0), (14, [1e-30, 0.0, 0.0], 0),
    ]
    vectors = spark.createDataFrame(rows, VECTORS)
    want = brute_nearest(rows, lambda i: True, 4)
    assert as_lists(neighbours.nearest(vectors, vectors, k=4)) == want
    none = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest(none, none).collect() == []
    assert neighbours.nearest(vectors, none).collect() == []
    assert neighbours.nearest(none, vectors).collect() == []


def test_bounds_hold():
    draw = np.random.default_rng(1)
    q, x = draw.normal(size=(40, 1500)), draw.normal(size=(60, 1500)) * 3
    least, most = neighbours.bounds(neighbours.Quantised(q), neighbours.Quantised(x))
    true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    assert (least <= true).all() and (true <= most).all()


def plain_base(text: str) -> list[tuple]:
    spans = []
    word = "(password|passwd|secret|token|api_?key)"
    word = re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word)
    pattern = word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for i, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                spans.append((m.start(), i + 1, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


@pytest.mark.parametrize("where", ["odd", "table"])
def test_base_spans(spark, where):
    if where == "odd":
        rows, found = odd_rows(), secrets.scan(odd(spark)).collect()
    else:
        rows = table_rows(spark, SMALL)
        found = secrets.scan(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    got = sorted(
        (r["doc_id"] or 0, [tuple(s) for s in r["spans"] if s["kind"] != "inferred"]) for r in found
    )
    assert got == sorted((r[0] or 0, plain_base(r[1] or "")) for r in rows)


def test_secret_query(spark):
    rows = {r[0]: r[1] or "" for r in table_rows(spark, SMALL)}
    for r in QUERIES["op7_secrets"](spark, SMALL).collect():
        base = plain_base(rows[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secrets.BASE] == [
            sum(s[0] == k for s in base) for k in secrets.BASE
        ]
        assert not text or set(text.split(",")) <= set(r["spans"].split(","))
    assert secrets.scan(empty(spark)).collect() == []


def test_formats_are_inferred(spark):
    """Credentials that no pattern names are found by their format; words are not."""
    draw = np.random.default_rng(2)
    make = lambda n: "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789"), n))
    rows = [(i, f"the token={make(28)} is here") for i in range(300)]
    parts = "inter nation al isa tion stand ard mis under re volu con tra ver sus ma ni fest".split()
    word = lambda n: "".join(draw.choice(parts, n))
    rows += [(1000 + i, f"{word(2)} {word(3)} {word(3)} {word(6)} {word(7)}-{word(3)}") for i in range(300)]
    hidden = [(2000 + i, f"before {make(28)} after") for i in range(50)]
    docs = spark.createDataFrame(rows + hidden, "doc_id bigint, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert sum(bool(found[i]) for i, _ in hidden) >= 48
    assert sum(bool(found[i]) for i, _ in rows[300:]) == 0
    assert all(found[i][0][0] == "assign" for i, _ in rows[:300])


def test_ordinary_text_is_counted_over_all_documents(spark):
    """Every word of every document, whatever its id and however many words there are."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(w) for w in letters[np.random.default_rng(3).integers(0, 26, (30_000, 8))]]
    texts = [" ".join(words[i::28]) + " short é-not-ascii" for i in range(28)]
    want = secrets.pair_counts(words)
    assert want[ord("a")] == sum(w[0] == "a" for w in words) and want[1 << 7] == 0
    for ids in (range(28), range(1000, 1028), [None] * 28):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(5)
        found = secrets.find(docs)
        assert found.filter("pairs IS NULL").count() == 28
        model = secrets.learn(found).ordinary
        assert np.array_equal(model.log, secrets.Ordinary(want).log)
    assert secrets.scan(docs).count() == 28


def test_automaton_merges_states():
    values = ["ab" * n for n in range(1, 9) for _ in range(2 ** (10 - n))]
    automaton = secrets.Automaton(values)
    assert len(automaton.settled) < 8
    assert automaton.log_likelihood("ababab") > automaton.log_likelihood("aabbab")


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = QUERIES["op10_toxicity"](spark, folder)
    rows = scored.join(labels, "doc_id").toPandas()
    assert rows["score"].between(0, 1).all()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"]]).all()
    apart = rows[rows["held_out"]]
    bad, good = apart[apart["toxic"] == 1]["score"], apart[apart["toxic"] == 0]["score"]
    area = np.mean([(s > good).mean() + (s == good).mean() / 2 for s in bad])
    assert area > 0.95
    assert (bad >= 0.7).mean() > 0.8 and (good >= 0.7).mean() < 0.01


def test_toxicity_on_odd_rows(spark):
    docs = odd(spark)
    labels = [(i, 0, int(i % 2)) for i in range(1, 33)] + [(None, 0, 1), (5, 0, None), (999, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.keep_clean(docs, model, limit=2.0)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows())
    assert toxicity.score(empty(spark), model).collect() == []
    none = toxicity.train(docs, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.train(docs, labels.filter("toxic = 1"))
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {1.0}


def test_isotonic_pools_rise():
    raw = np.array([0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    at, share = toxicity.fit_isotonic(raw, np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all()


def test_pipeline(spark):
    """Stage by stage against plain versions, each on what the one before kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    clean = {r["doc_id"] for r in scores if r["score"] < 0.7}
    rows = [r for r in table_rows(spark, SMALL) if r[0] in clean]
    stay = {doc_id for doc_id, _ in exact_groups(rows).values()}
    rows = [r for r in rows if r[0] in stay]
    roots = {root for _, root in near_classes(rows, 5, 80, 100).values()}
    rows = [r for r in rows if r[0] in roots]
    want = {}
    targets = mixture(rows)
    for doc_id, text, _, source, _ in rows:
        size, target = targets[source]
        rate = target / size if size else 0.0
        draw = int(hashlib.md5(f"mix:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        copies = int(rate) + (draw < rate - int(rate))
        if copies:
            want[doc_id] = (copies, hashlib.sha256((text or "").encode()).hexdigest())
    got: dict = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        assert hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]
        got[r["doc_id"]] = (got.get(r["doc_id"], (0,))[0] + 1, r["decoded_sha256"])
    assert got == want


def test_pipeline_stages_take_odd_and_empty_tables(spark):
    import corpus_pipeline

    for start in (odd(spark), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == start.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() <= 3 * len(odd_rows())
