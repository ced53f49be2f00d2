"""Token counts, byte-level BPE and mixing against libraries and plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from odd import empty, mixture, odd, odd_rows, table_rows
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, mixing, token_counts
from tidemark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding(
    "own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
)


def packed(text: str) -> bytes:
    return np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()


def test_counts_of_odd_rows(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in odd_rows())
    for chars in (4000, 7):
        got = token_counts.token_counts(odd(spark), PIECES, piece_chars=chars, call_bytes=500)
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.token_counts(empty(spark), PIECES).collect() == []


def test_counts_of_documents(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in QUERIES["op5_token_counts"](spark, SMALL).collect()}
    for doc_id, text, *_ in table_rows(spark, SMALL):
        n = len(model.encode(text or ""))
        assert (got[doc_id]["n_tokens"], got[doc_id]["over_limit"]) == (n, n > 4096)


def test_texts_are_cut_at_safe_places_only():
    assert token_counts.safe_parts("aa bb  cc é dd", 1) == ["aa", "bb  cc é dd"]
    assert " ".join(token_counts.safe_parts("a b c d e f", 2)) == "a b c d e f"
    assert token_counts.crosses_words(["▁a", "a▁b"]) and not token_counts.crosses_words(["▁▁a"])
    calls = list(token_counts.calls_of([5, 900, 20, 30], 100))
    assert sorted(sum(calls, [])) == [0, 1, 2, 3] and calls[0] == [1]


def test_bpe_of_odd_rows(spark):
    got = byte_bpe.round_trip(odd(spark), RANKS, PATTERN).collect()
    want = sorted((packed(r[1] or ""), (r[1] or "").encode()) for r in odd_rows())
    assert sorted(bytes(r["ids"]) for r in got) == [w[0] for w in want]
    assert sorted(r["decoded_sha256"] for r in got) == sorted(
        hashlib.sha256(w[1]).hexdigest() for w in want
    )
    back = byte_bpe.decode(byte_bpe.encode(odd(spark), RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted(w[1] for w in want)
    assert byte_bpe.round_trip(empty(spark), RANKS, PATTERN).collect() == []


def test_bpe_of_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op9_byte_bpe"](spark, SMALL).collect()}
    for doc_id, text, *_ in table_rows(spark, SMALL):
        ids = packed(text or "")
        assert got[doc_id]["n_tokens"] == len(ids) // 4
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_random_texts():
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), PATTERN)
    signs = "ab \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 ​　'sé中0९²Ⅷ!?́😀 ﻿ſ"
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 14)))
        assert codec.encode_batch([text])[0] == packed(text)


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"key{i}".encode() for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(5000))
    assert sorted(table.key_at.tolist()) == list(range(5000))
    assert (table.find([b"none", b"", b"key5000"]) == -1).all()


def test_remembered_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), PATTERN)
    texts = [" ".join(f"piece{i}x{j}" for j in range(20)) for i in range(30)] * 2
    assert codec.encode_batch(texts) == [packed(t) for t in texts]
    assert len(codec._known) <= 120


def test_mixture_of_odd_rows(spark):
    want = mixture(odd_rows())
    planned = mixing.plan_mix(odd(spark)).select("doc_id", "source", "mix.*").collect()
    assert len(planned) == len(odd_rows())
    for r in planned:
        size, target = want[r["source"]]
        assert r["source_size"] == size and abs(r["target"] - target) < 1e-6 * max(1, target)
        assert 0 <= r["copies"] <= 3
        rate = target / size if size else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1
    mixed = mixing.mix(odd(spark))
    assert mixed.columns == odd(spark).columns
    assert mixed.count() == sum(r["copies"] for r in planned)
    assert mixing.mix(empty(spark)).collect() == [] == mixing.plan_mix(empty(spark)).collect()


def test_mixture_of_documents(spark):
    rows = table_rows(spark, SMALL)
    want = mixture(rows)
    first, again = (
        sorted(map(tuple, QUERIES["op8_mixing"](spark, SMALL).collect())) for _ in range(2)
    )
    assert first == again
    source = {r[0]: r[3] for r in rows}
    for doc_id, size, source_size, target, taken in first:
        assert source_size == want[source[doc_id]][0] and taken <= 3 * size
        assert abs(target - want[source[doc_id]][1]) < 1e-6 * max(1, target)


def test_targets_share_the_excess_again(spark):
    totals = [("a", 1), ("b", 10), ("c", 1000), (None, 5), ("d", 0)]
    rows = [(i, " ".join(["w"] * n), "en", s, 0) for i, (s, n) in enumerate(totals)]
    got = mixing.source_targets(spark.createDataFrame(totals, "source string, source_size bigint"))
    want = mixture(rows)
    assert {r["source"]: round(r["target"], 6) for r in got.collect()} == {
        s: round(t, 6) for s, (_, t) in want.items()
    }
    assert abs(sum(t for _, t in want.values()) - 1016) < 1e-6


def test_mixing_stays_native(spark):
    plan = mixing.mix(odd(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_draws_are_even(spark):
    ids = spark.range(4000).select(mixing.draw("id", "mix").alias("u"))
    low, mean, high = ids.agg(F.min("u"), F.avg("u"), F.max("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.03
