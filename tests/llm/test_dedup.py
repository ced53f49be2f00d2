"""Line, exact, near and substring deduplication on odd rows and against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from odd import LINE, empty, exact_groups, near_classes, odd, odd_rows, table_rows

from tidemark.llm import exact_dedup, line_dedup, ngram_join, substring_dedup
from tidemark.llm.components import components

SMALL = "/root/testdata/sf0.001"


def test_lines(spark):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd(spark)).collect()}
    assert (got[1]["n_lines"], got[1]["n_dropped"], got[1]["text"]) == (1, 0, "")
    assert (got[4]["n_lines"], got[4]["n_dropped"]) == (2, 1)
    assert got[4]["text"] == "first own line of document four"
    assert (got[5]["n_lines"], got[5]["n_dropped"], got[5]["text"]) == (3, 2, "second")
    assert got[6]["text"] == f"{LINE}\n\n" and got[6]["n_dropped"] == 0
    assert line_dedup.dedup_lines(odd(spark)).count() == len(odd_rows())
    assert line_dedup.dedup_lines(empty(spark)).collect() == []


def test_lines_with_a_full_filter(spark):
    """A filter too small for the keys only lets more lines through."""
    docs = odd(spark)
    from tidemark.llm import bloom

    seen = bloom.SeenTwice(bloom.SEGMENT_BITS)
    import numpy as np

    keys = np.arange(1, 200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen.add(keys)
    seen.add(keys[:1000])
    assert bloom.test_bits(seen.twice, bloom.positions(keys[:1000], seen.bits)).all()
    assert line_dedup.suspects(docs).count() >= 3


def test_lines_of_null_ids(spark):
    rows = [(None, "a line that null ids hold too")] * 2 + [(1, "a line that null ids hold too")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in got.collect()) == [(0, 1), (0, 1), (1, 0)]
    only = line_dedup.dedup_lines(
        spark.createDataFrame(rows[:2] * 2, "doc_id bigint, text string")
    )
    assert [r["n_dropped"] for r in only.collect()] == [0] * 4


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 40])
def test_exact(spark, bucket_bytes):
    """However small the buckets, and however often they are split again."""
    rows = odd_rows()
    want = exact_groups(rows)
    got = exact_dedup.exact_groups(odd(spark), table_bytes=3000, bucket_bytes=bucket_bytes).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(b.encode()).digest(): g for b, g in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_digest[bytes(r["digest"])]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_filter(spark):
    docs = odd(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    want = {}
    for doc_id, text, *_ in odd_rows():
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        if exact_groups(odd_rows())[bare][0] == doc_id:
            want[(doc_id or 0, bare)] = (doc_id or 0, text or "")
    assert got == sorted(want.values())
    assert exact_dedup.drop_copies(empty(spark)).collect() == []
    assert exact_dedup.exact_groups(empty(spark)).collect() == []


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (1, 50, 100)])
def test_near(spark, n, num, den):
    want = near_classes(odd_rows(), n, num, den)
    got = ngram_join.near_groups(odd(spark), n, num, den).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


@pytest.mark.parametrize("n, num, den", [(5, 80, 100), (2, 60, 100)])
def test_near_on_documents(spark, n, num, den):
    want = near_classes(table_rows(spark, SMALL), n, num, den)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_groups(docs, n, num, den).collect()}
    assert got == want
    if n == 5:
        kept = ngram_join.drop_near_copies(docs, n, num, den)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {root for _, root in want.values()}


def test_near_small_sets(spark):
    """Sets of every small size, on both sides of the boundary."""
    rows, number = [], 0
    for size in range(1, 31):
        words = [f"w{size}_{i}" for i in range(size)]
        for change in range(4):
            number += 1
            rows.append((number, " ".join([*words[: size - change], *[f"c{number}_{i}" for i in range(change)]])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for num, den in ((90, 100), (75, 100)):
        want = near_classes(rows, 1, num, den)
        got = {r[0]: (r[1], r[2]) for r in ngram_join.near_groups(docs, 1, num, den).collect()}
        assert got == want


def test_boundary_weighs_cost():
    assert ngram_join.boundary({20: 100}, 1.0, 90, 100) < 20
    assert ngram_join.boundary({5: 100, 20: 100}, 1000.0, 90, 100) >= 5
    members = list(range(1, 11))
    assert set(ngram_join.subset_keys(members, 10, 90, 100)) & set(
        ngram_join.subset_keys([*members[:9], 99], 10, 90, 100)
    )


def test_near_empty(spark):
    assert ngram_join.near_groups(empty(spark)).collect() == []
    assert ngram_join.drop_near_copies(empty(spark)).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == {
        **{i: 1 for i in range(1, 41)},
        **{i: 90 for i in (90, 95, 100)},
    }


def test_passages(spark):
    got = substring_dedup.repeated_spans(odd(spark)).collect()
    rows = {r[0]: r[1] for r in odd_rows()}
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append(r)
        found = rows[r["doc_id"]].encode()[r["start"] : r["stop"]]
        assert found in rows[r["first_doc"]].encode() or r["doc_id"] in (21, 22, 23)
    assert {10, 11, 12, 20, 21, 22, 23} <= set(spans) and not {7, 8, 9, 30, 31, 32} & set(spans)
    # At a passage's edges two documents may share a chunk that the first one cuts elsewhere.
    assert {r["first_doc"] for r in spans[10]} == {10} and 10 in {r["first_doc"] for r in spans[11]}
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(odd(spark)).collect()}
    assert kept[10] == rows[10] and kept[9] == "single" and kept[1] == ""
    assert len(kept[12]) < 200 and kept[12].startswith("another text altogether")
    assert substring_dedup.repeated_spans(empty(spark)).collect() == []
    assert substring_dedup.drop_repeats(empty(spark)).collect() == []


def spans_by_doc(docs) -> dict:
    """doc_id -> spans (start, stop), those that touch as one."""
    out: dict = {}
    for r in sorted(substring_dedup.repeated_spans(docs).collect()):
        mine = out.setdefault(r["doc_id"], [])
        if mine and mine[-1][1] == r["start"]:
            mine[-1][1] = r["stop"]
        else:
            mine.append([r["start"], r["stop"]])
    return out


@pytest.mark.parametrize("n", [64, 128, 256])
def test_clean_documents_have_no_passages(spark, n):
    """Any five words (110 bytes) are in two documents, any six in one: chunks come again,
    from one document after the other, but no passage does."""
    draw = np.random.default_rng(5)
    texts = []
    for _ in range(n // 64):
        state, steps = np.arange(64), [[] for _ in range(64)]
        for _ in range(60):
            words = ["".join(draw.choice(list("abcdefghijklmnop "), 22)) for _ in range(2)]
            bit = (state >> 5) ^ draw.integers(0, 2, 32)[state & 31]
            state = (state << 1 | bit) & 63
            for mine, x in zip(steps, bit):
                mine.append(words[x])
        texts += map("".join, steps)
    held: dict = {}
    for i, text in enumerate(texts):
        for j in range(len(text) - 119):
            held.setdefault(text[j : j + 120], set()).add(i)
    # The first words do not tell all documents apart yet.
    clean = set(range(n)) - {i for h in held.values() if len(h) > 1 for i in h}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len(clean) > n / 2 and not clean & set(spans_by_doc(docs))


def test_spans_are_held_by_one_other_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r[0]: (r[1] or "").encode() for r in table_rows(spark, SMALL)}
    got = spans_by_doc(docs)
    assert got
    for doc_id, spans in got.items():
        for start, stop in spans:
            assert stop - start >= 120
            for piece in (texts[doc_id][start : start + 120], texts[doc_id][stop - 120 : stop]):
                assert any(piece in t for i, t in texts.items() if i != doc_id)


def test_windows_cover_runs():
    draw = np.random.default_rng(7)
    for _ in range(300):
        bounds = np.cumsum(draw.integers(1, 200, draw.integers(2, 15)))
        got = substring_dedup.windows(bounds, 120).tolist()
        assert all(b - a >= 120 for a, b in got)
        for i in range(len(bounds)):
            for j in range(i + 1, len(bounds)):
                if bounds[j] - bounds[i] >= 120:
                    inside = [w for w in got if bounds[i] <= w[0] and w[1] <= bounds[j]]
                    assert substring_dedup.merged([[*w, 0] for w in sorted(inside)]) == [[bounds[i], bounds[j], 0]]


def test_chunks_cover_texts_and_resist_shifts():
    texts = [r[1].encode() for r in odd_rows() if r[1]] * 2
    for number, bounds in substring_dedup.chunked(texts):
        assert bounds[0] == 0 and bounds[-1] == len(texts[number])
        assert all(0 < b - a <= 256 for a, b in zip(bounds, bounds[1:]))
    base = " ".join(f"v{i * 7 % 1013}" for i in range(400)).encode()
    moved = base[:700] + b" some words put in " + base[700:]
    (_, a), (_, b) = substring_dedup.chunked([base, moved])
    chunks = {base[i:j] for i, j in zip(a, a[1:])}
    same = sum(j - i for i, j in zip(b, b[1:]) if moved[i:j] in chunks)
    assert same > 0.9 * len(base)


def test_every_long_passage_is_found(spark):
    """Against all runs of 60 words that two documents share."""
    holders: dict = {}
    for doc_id, text, *_ in table_rows(spark, SMALL):
        words = (text or "").split()
        for i in range(len(words) - 59):
            holders.setdefault(tuple(words[i : i + 60]), set()).add(doc_id)
    want = {i for h in holders.values() if len(h) > 1 for i in h}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"] for r in substring_dedup.repeated_spans(docs).select("doc_id").collect()}
    assert want <= got
