import hashlib
import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bigrams, inference, scoring, similarity
from tidemark.plans.scratch import scratch_dir


def test_similarity(spark):
    rows = [(1, [3.0, 4.0], [3.0, 4.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0, 0.0], [-2.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, gen_vec array<float>, ref_vec array<float>")
    got = {r["id"]: r["similarity"] for r in similarity.pair_similarity(df).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: pytest.approx(-1.0)}
    assert similarity.embedding_similarity(df.limit(0)).first()["similarity"] == 0.0


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return dot / (max(math.hypot(*a), 1e-9) * max(math.hypot(*b), 1e-9))


VECTORS = [[math.sin(i * 7 + k) for k in range(5)] for i in range(40)]


@pytest.fixture(scope="module")
def vectors(spark):
    """One group holds most rows, one has a single member."""
    rows = [(i, "hot" if i < 36 else f"g{i // 2}", v) for i, v in enumerate(VECTORS)]
    rows.append((99, "single", [1.0, 2.0, 3.0, 4.0, 5.0]))
    return spark.createDataFrame(rows, "id bigint, g string, v array<double>").repartition(5)


def test_diversity_is_about_the_first_member(spark, vectors):
    rows = similarity.embedding_diversity(vectors, "g", "v", "id").collect()
    got = {r["g"]: r["diversity"] for r in rows}
    want = 1 - sum(cosine(VECTORS[0], v) for v in VECTORS[1:36]) / 35
    assert got["hot"] == pytest.approx(want)
    assert got["single"] == 0.0


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_coherence_does_not_depend_on_the_blocks(spark, vectors, block):
    rows = similarity.coherence(vectors, "g", "id", "v", block).collect()
    got = {r["g"]: r["coherence"] for r in rows}
    want = sum(cosine(VECTORS[i], VECTORS[i + 1]) for i in range(35)) / 35
    assert got["hot"] == pytest.approx(want)
    assert got["single"] == 0.0


def test_logit_ties_and_case(spark):
    rows = [(1, [0.5, 0.5, 0.1, 0.0], "a"), (2, [0.0, 0.1, 0.9, 0.9], " C "), (3, [0.0, 0.0, 0.0, 9.0], "A")]
    df = spark.createDataFrame(rows, "id int, scores array<float>, reference string")
    letters = {"A": 0, "B": 1, "C": 2, "D": 3}
    got = {r["id"]: (r["predicted"], r["score"]) for r in scoring.logit_accuracy(df, letters).collect()}
    assert got == {1: ("A", 1.0), 2: ("C", 1.0), 3: ("D", 0.0)}
    vocab = spark.createDataFrame([(0, " a "), (2, "x"), (3, "A")], "token_id int, token string")
    got = {r["id"]: (r["predicted"], r["score"]) for r in scoring.logit_accuracy(df, None, vocab).collect()}
    assert got == {1: ("a", 1.0), 2: ("x", 0.0), 3: ("A", 1.0)}


def test_perplexity(spark):
    scores = spark.createDataFrame([(1, 0, -1.0), (1, 1, -3.0)], "seq_id bigint, pos int, logprob double")
    seqs = spark.createDataFrame([(1,), (2,)], "seq_id bigint")
    got = {r["seq_id"]: r["perplexity"] for r in scoring.perplexity(scores, seqs).collect()}
    assert got == {1: pytest.approx(math.exp(2)), 2: math.inf}


def test_bigram_perplexity_by_hand(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "b"), (3, "")], "id bigint, text string")
    got = {r["id"]: r for r in scoring.bigram_perplexity(df, "id", "text").collect()}
    # counts: a 2, b 3, two words; a-b twice, b-a once
    ab, ba = math.log(3 / 4), math.log(2 / 5)
    assert got[1]["bigram_ppl"] == pytest.approx(math.exp(-(2 * ab + ba) / 3))
    assert (got[1]["scored"], got[2]["scored"], got[3]["scored"]) == (3, 0, 0)
    assert got[2]["bigram_ppl"] == got[3]["bigram_ppl"] == math.inf


def test_generation_config(spark):
    df = spark.createDataFrame([("mcq",), ("ssg",), ("other",)], "task_type string")
    got = {r["task_type"]: tuple(r)[1:] for r in scoring.generation_config(df).collect()}
    assert got == {"mcq": (0.0, 4, False), "ssg": (0.7, 100, True), "other": (0.7, 100, True)}
    own = scoring.generation_config(df, max_new_tokens=F.lit(7)).collect()
    assert {r["max_new_tokens"] for r in own} == {7}


class Touchy:
    def generate(self, prompts, temperatures, max_new_tokens):
        if any("bad" in p for p in prompts):
            raise ValueError("bad prompt")
        return [f"  {p.upper()} " for p in prompts]


def test_generate_isolates_failures(spark):
    rows = [("ok", "mcq"), ("bad one", "mt"), ("fine", "ssg"), ("x", "nonsense")]
    df = spark.createDataFrame(rows, "prompt string, task_type string").coalesce(1)
    got = {r["prompt"]: r for r in inference.batch_generate(df, model_factory=Touchy).collect()}
    assert got["ok"]["generation"] == "OK" and got["fine"]["status"] == "completed"
    assert got["bad one"]["error"] == "ValueError: bad prompt"
    assert got["x"]["error"] == "invalid task type"
    stub = {r["task_type"]: r["generation"] for r in inference.batch_generate(df).collect()}
    assert stub["mcq"] == "A" and stub["nonsense"] == "Stub response"


def test_default_embedding_is_stable_and_unit(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in inference.embed_column(df).collect()}
    assert len(got[1]) == 384 and got[1] == got[2]
    assert math.hypot(*got[1]) == pytest.approx(1.0, abs=1e-6)
    assert set(got[3]) == {0.0}


def test_default_embedding_counts_hashed_tokens(spark):
    """A token's place is the first 8 hex digits of its MD5, modulo the dimension."""
    row = inference.embed_column(spark.createDataFrame([("x y x",)], "text string")).first()
    want = [0.0] * 384
    for token in ("x", "y", "x"):
        want[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 384] += 1
    length = math.hypot(*want)
    assert row["embedding"] == pytest.approx([v / length for v in want], abs=1e-6)


def perplexities(docs):
    """(scored, perplexity) of each row of (key, tokens), counted one by one."""
    words, pairs, own = Counter(), Counter(), {}
    for key, tokens in docs:
        tokens = tokens or []
        words.update(t for t in tokens if t is not None)
        near = [p for p in zip(tokens, tokens[1:]) if None not in p]
        pairs.update(near)
        own.setdefault(key, []).extend(near)
    logp = {p: math.log((c + 1) / (words[p[0]] + len(words))) for p, c in pairs.items()}
    mean = lambda some: math.exp(-sum(logp[p] for p in some) / len(some)) if some else math.inf
    return [(key, *((0, math.inf) if key is None else (len(own[key]), mean(own[key])))) for key, _ in docs]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_bigram_perplexity_over_chunks_and_buckets(spark, monkeypatch, size):
    """Texts longer than a chunk, keys that repeat or are null, tokens that are null or hold any byte."""
    monkeypatch.setattr(bigrams, "CHUNK_TOKENS", size)
    monkeypatch.setattr(bigrams, "BUCKET_ITEMS", 16)
    draw = random.Random(size)
    some = ["a", "b", "", " ", "\0", "\1", "\1\2", "a\0", "\0a", "ä", "long" * 90, "null", None]
    docs = [(draw.choice([None, *range(20)]), draw.choices(some, k=draw.choice([0, 1, 2, 5, 40]))) for _ in range(30)]
    docs += [(50, None), (51, [None, None]), (52, ["a"] * 200)]
    df = spark.createDataFrame(docs, "id bigint, t array<string>").repartition(3)
    got = scoring.bigram_perplexity(df, "id", "t", tokenizer=lambda column: column).collect()
    by = lambda row: (row[0] is None, row)
    assert sorted(map(tuple, got), key=by) == [
        (key, n, pytest.approx(ppl)) for key, n, ppl in sorted(perplexities(docs), key=by)
    ]


def test_bigram_perplexity_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, [None])], "id bigint, t array<string>")
    got = scoring.bigram_perplexity(df, "id", "t", tokenizer=lambda column: column)
    assert sorted(map(tuple, got.collect())) == [(1, 0, math.inf), (2, 0, math.inf)]
    assert scoring.bigram_perplexity(df.limit(0), "id", "t", tokenizer=lambda column: column).count() == 0


def test_bigrams_take_less_disk_than_the_texts(spark):
    """Kept tables, where each bigram was written twice beside the tokens."""
    draw = random.Random(1)
    texts = [(i, " ".join(f"word{draw.randrange(5000)}" for _ in range(500))) for i in range(200)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    kept = Path(scratch_dir(spark, "x").removeprefix("file://")).parent
    used = lambda: sum(p.stat().st_size for p in kept.rglob("*.parquet"))
    before = used()
    assert scoring.bigram_perplexity(df, "id", "text").count() == 200
    assert used() - before < 0.6 * sum(len(t) for _, t in texts)
