"""Decontamination, lexical search and periodic runs on odd rows and against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import PASSAGE, empty, odd, odd_rows, table_rows

from tidemark.llm import decontamination, lexical_search, periodic_runs
from tidemark.llm.queries import op13

SMALL = "/root/testdata/sf0.001"
ITEMS = "item_id bigint, text string"

ITEM_ROWS = [
    (0, None),
    (1, ""),
    (2, " ".join(PASSAGE.split()[5:40])),
    (3, "single"),
    (4, "ONE, two!"),
    (4, "same text of a copy"),
    (5, "not found in any document at all"),
    (6, " ".join(PASSAGE.split()[30:41]).upper()),
    (None, "text without an id"),
    (7, "text of a copy"),
    (8, "x" * 50_000 + " long"),
    (9, "long words long words long words long words long words long words"),
]


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def hits(text, items, window: int) -> tuple:
    """(n_words, hit words, items), by trying every window at every word."""
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        size = min(window, len(own))
        starts = range(len(own) - size + 1) if own else ()
        wins = {tuple(own[i : i + size]) for i in starts}
        for i in range(len(words) - size + 1) if wins else ():
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(item)
    return len(words), hit, sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("window, width, block", [(10, 5, 1 << 19), (4, 2, 20), (1, 3, 7)])
def test_contamination(spark, window, width, block):
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    got = decontamination.contamination(odd(spark), items, window, width, block).collect()
    rows = [r for r in odd_rows() if len(r[1] or "") < 1000 or window > 1]
    assert len(got) == len(odd_rows())
    want = Counter()
    for doc_id, text, *_ in rows:
        n, hit, found = hits(text, ITEM_ROWS, window)
        want[doc_id, n, tuple(sorted(hit)), tuple(found)] += 1
    kept = {r[0] for r in rows}
    have = Counter(
        (
            r["doc_id"],
            r["n_words"],
            tuple(i for s in r["spans"] for i in range(s["start"], s["stop"])),
            tuple(r["items"]),
        )
        for r in got
        if r["doc_id"] in kept
    )
    assert have == want
    for r in got:
        ends = [s["start"] for s in r["spans"]][1:]
        assert all(s["stop"] < e for s, e in zip(r["spans"], ends))


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], ITEMS)
    got = decontamination.contamination(odd(spark), none).collect()
    assert len(got) == len(odd_rows()) and not any(r["spans"] or r["items"] for r in got)
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert decontamination.contamination(empty(spark), items).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " .,")], ITEMS)
    assert not any(r["spans"] for r in decontamination.contamination(odd(spark), blank).collect())


def test_rarest_shingle_is_the_prefix(spark):
    """A window is looked up by the shingle that the corpus holds least often."""
    docs = spark.createDataFrame(
        [(i, "a b c d e") for i in range(9)] + [(10, "a b c d e f g h i j")],
        "doc_id bigint, text string",
    )
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")], ITEMS)
    windows = decontamination.item_windows(items, 10)
    shingles = decontamination.window_shingles(windows, 5)
    found = decontamination.found_shingles(docs, shingles)
    prefix = decontamination.rarest_shingles(shingles, found.filter("at >= 0")).collect()
    assert [(r["window"], r["shingle"]) for r in prefix] == [("a b c d e f g h i j", "f g h i j")]


def best(rows: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """Every document scored for every item."""
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
    docs = [(r[0], Counter(cut(r[1]))) for r in rows]
    documents, length = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(cut(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc_id, counts in docs:
            m = 75 + (25 * counts.total() * documents) // max(length, 1)
            score = 0
            for term, repeats in terms.items():
                if tf := counts[term]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[term] + 1)))
                    score += repeats * w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, doc_id, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, block", [(20, 1 << 18), (2, 1), (1, 10)])
def test_search(spark, k, block):
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    got = lexical_search.search(odd(spark), items, k, block).collect()
    assert sorted(map(tuple, got), key=repr) == best(odd_rows(), ITEM_ROWS, k)


def test_search_in_small_groups():
    """Limits carry over from group to group, and accumulators stop being made."""
    rnd = random.Random(5)
    vocabulary = [f"t{i}".encode() for i in range(40)]
    numbers = {t: i for i, t in enumerate(vocabulary)}
    weights = [rnd.randrange(0, 60) ** 3 for _ in range(400)]
    docs = [
        (i, " ".join(f"t{min(39, int(rnd.expovariate(0.15)))}" for _ in range(rnd.randrange(0, 60))))
        for i in range(len(weights))
    ]
    items = [(1, "t0 t1 t2 t30 t35"), (2, "t39 t0"), (3, "t20 t20 t3 t2 t1 t0")]
    want = best(docs, items, 3)
    counted = [(i, lexical_search.term_counts(t.encode())) for i, t in docs]
    n, length = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(numbers[t] for _, c in counted for t in c)
    import pyarrow as pa

    for size in (1, 7, 100, 400):
        held = lexical_search.Best(3)
        for at in range(0, len(docs), size):
            part = counted[at : at + size]
            batch = pa.record_batch(
                {
                    "doc_id": pa.array([i for i, _ in part], pa.int64()),
                    "n": pa.array([c.total() for _, c in part], pa.int64()),
                    "terms": pa.array([[numbers[t] for t in c] for _, c in part], pa.list_(pa.int32())),
                    "counts": pa.array([list(c.values()) for _, c in part], pa.list_(pa.int64())),
                }
            )
            group = lexical_search.Group([batch], n, length)
            for item, text in items:
                terms = Counter(numbers[t.encode()] for t in text.split())
                order = sorted(terms, key=lambda t: (df[t], t))
                gains = [
                    terms[t] * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in order
                ]
                group.answer(item, np.array(order), np.array(gains, np.int64), held)
        got = [
            (item, rank, int(doc), int(score))
            for item, (scores, ids, _) in held.of.items()
            for rank, (score, doc) in enumerate(zip(scores, ids), 1)
        ]
        assert sorted(got, key=repr) == want


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert lexical_search.search(empty(spark), items).collect() == []
    assert lexical_search.search(odd(spark), spark.createDataFrame([], ITEMS)).collect() == []


def test_terms_in_slices(monkeypatch):
    text = ("Überall a1 B-c " * 50).encode()
    whole = lexical_search.term_counts(text)
    monkeypatch.setattr(lexical_search, "_SLICE", 7)
    assert lexical_search.term_counts(text) == whole and whole["b".encode()] == 50


def every_run(w: list, repeats: int = 4, least: int = 6) -> list[tuple]:
    """Each lag, each stretch, and the smallest period by trying all."""
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                if not any(
                    all(w[t] == w[t + d] for t in range(i, i + length - d)) for d in range(1, q)
                ):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("repeats", [3, 4, 5])
def test_runs(repeats):
    rnd = random.Random(repeats)
    for _ in range(1500):
        n, k = rnd.randrange(0, 70), rnd.choice([1, 2, 3, 5, 10])
        w = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randrange(0, 4) if n > 8 else 0):
            a, p, m = rnd.randrange(n), rnd.randrange(1, 12), rnd.randrange(4, 50)
            for i in range(a, min(n, a + m)):
                w[i] = w[a + (i - a) % p]
        assert periodic_runs.runs_of(np.array(w, np.int32), repeats) == every_run(w, repeats)


def test_segments_are_stable():
    rnd = random.Random(3)
    for _ in range(300):
        ids = np.array([int(rnd.expovariate(0.2)) for _ in range(rnd.randrange(0, 200))], np.int32)
        for low, high in periodic_runs.segments(ids, 4, 6):
            assert min(Counter(ids[low:high].tolist()).values()) >= 4
    chain = [x for j in range(4000) for x in (j, j + 1) * 4]  # one split in each part, again and again
    assert len(periodic_runs.runs_of(np.array(chain, np.int32))) == 4000


def test_long_regular_texts():
    n = 60_000
    assert periodic_runs.runs_of(np.zeros(n, np.int32)) == [(0, n, 1)]
    block = np.random.default_rng(1).integers(0, 500, n // 5).astype(np.int32)
    assert (0, n, n // 5) in periodic_runs.runs_of(np.tile(block, 5))


def test_words_in_slices(monkeypatch):
    text = " ab\tc  ab\x85é \n" * 40
    whole, words = periodic_runs.numbered_words(text)
    monkeypatch.setattr(periodic_runs, "_SLICE", 5)
    ids, again = periodic_runs.numbered_words(text)
    assert ids.tolist() == whole.tolist() and again == words == ["ab", "c", "ab\x85é"]


def test_runs_of_rows(spark):
    got = periodic_runs.periodic_runs(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_words"] == 0 and by_id[1]["strongest"] is None and by_id[1]["collapsed"] == ""
    assert [tuple(r) for r in by_id[30]["runs"]] == [(1, 40_000, 2)]
    assert by_id[30]["collapsed"] == "x" * 50_000 + " long words"
    assert periodic_runs.periodic_runs(empty(spark)).collect() == []


def test_run_query(spark):
    """All columns of the query, with the planted repeats, by the plain version."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in op13(spark, SMALL).collect()}
    rows = table_rows(spark, SMALL)
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = every_run(words)
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        r = got[doc_id]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (top or (None,) * 3)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
