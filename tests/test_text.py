import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import ngrams as ng
from tidemark.operators import scoring


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("v")))["v"]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, cand string, ref string")


def test_tokens_are_words_and_symbols(spark):
    assert value(spark, tx.tokenize(F.lit("It's 3.14, né?"))) == [
        "It", "'", "s", "3", ".", "14", ",", "né", "?",
    ]


@pytest.mark.parametrize(
    "n, want", [(0, []), (2, [["a", "b"], ["b", "c"]]), (3, [["a", "b", "c"]]), (4, [])]
)
def test_ngrams_guard(spark, n, want):
    tokens = F.array(*[F.lit(c) for c in "abc"])
    assert value(spark, tx.ngrams(tokens, n)) == want
    assert value(spark, tx.gram_keys(tokens, n)) == [" ".join(g) for g in want]
    assert value(spark, tx.ngrams(F.array().cast("array<string>"), n or 1)) == []


def test_gram_keys_of_odd_tokens_stay_apart(spark):
    left = F.array(F.lit("a b"), F.lit("c"))
    right = F.array(F.lit("a"), F.lit("b c"))
    assert value(spark, tx.gram_keys(left, 2)) == value(spark, tx.gram_keys(right, 2))
    assert value(spark, tx.gram_keys(left, 2, True)) != value(spark, tx.gram_keys(right, 2, True))


@pytest.mark.parametrize(
    "text, want",
    [("3.14! ok?", ["3", "14", "ok"]), ("...!?", []), (" a\n.  b ", ["a", "b"]), ("", []), (None, None)],
)
def test_split_sentences(spark, text, want):
    assert value(spark, tx.split_sentences(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "text, want",
    [("the answer is b.", "B"), ("Cab", None), ("éA", None), ("_A_", None), ("x) D", "D"), ("", None), ("A", "A")],
)
def test_mcq_letter(spark, text, want):
    df = spark.createDataFrame([(text, " b ")], "generation string, reference string")
    row = one(scoring.mcq_regex_accuracy(df))
    assert row["predicted"] == want
    assert row["score"] == (1.0 if want == "B" else 0.0)


def overlap(spark, rows, n=2):
    return one(ng.corpus_ngram_overlap(pairs(spark, rows), n))["overlap"]


def test_overlap_is_a_clipped_recall(spark):
    assert overlap(spark, [(1, "a b a b", "a b")]) == 1.0
    assert overlap(spark, [(1, "a b", "a b a b")]) == pytest.approx(1 / 3)
    assert overlap(spark, [(1, "a b c", "x"), (2, "a b", "a b c")]) == 0.5
    assert overlap(spark, [(1, "a", "b")]) == 0.0
    assert overlap(spark, []) == 0.0


def bleu(spark, rows):
    return one(ng.corpus_bleu(pairs(spark, rows)))["bleu"]


def test_bleu(spark):
    assert bleu(spark, [(1, "a b c d e", "a b c d e")]) == pytest.approx(1.0)
    assert bleu(spark, []) == 0.0
    short = bleu(spark, [(1, "a b c d", "a b c d e f g h")])
    assert short == pytest.approx(math.exp(1 - 2))
    # no 4-grams at all: the missing order still enters the mean
    no_four = bleu(spark, [(1, "a b c", "a b c")])
    assert no_four == pytest.approx(math.exp(math.log(1e-9) / 4), rel=1e-6)


def brute_bleu_counts(rows, n):
    from collections import Counter

    def grams(text):
        t = text.split()
        return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))

    return sum(sum((grams(c) & grams(r)).values()) for _, c, r in rows)


def test_clipped_counts_ignore_order_and_partitioning(spark):
    rows = [(i, "a b a c " * (i % 5), "b a c a " * (i % 3)) for i in range(60)]
    base = ng.clipped_counts(pairs(spark, rows), [1, 2, 3])
    again = ng.clipped_counts(pairs(spark, rows[::-1]).repartition(7), [1, 2, 3])
    assert sorted(base.collect()) == sorted(again.collect())
    for row in base.collect():
        assert row["matches"] == brute_bleu_counts(rows, row["n"])


def test_bleu_does_not_shuffle_the_ngrams(spark):
    df = ng.corpus_bleu(pairs(spark, [(1, "a b", "a b")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pair_id" in plan
    assert "gram" not in [p for p in plan.splitlines() if "hashpartitioning" in p][0]


def test_diversity(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "a"), (3, "")], "id bigint, text string")
    got = {r["id"]: r["diversity"] for r in ng.ngram_diversity(df, "id", "text").collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 0.0, 3: 0.0}
    corpus = one(ng.corpus_ngram_diversity(df.withColumn("g", F.lit(1)), ["g"], "text"))
    assert (corpus["distinct_grams"], corpus["total_grams"]) == (2, 3)
    roughly = one(ng.corpus_ngram_diversity(df.withColumn("g", F.lit(1)), ["g"], "text", 2, True))
    assert roughly["distinct_grams"] == 2


def test_any_tokenizer_may_be_used(spark):
    chars = lambda c: F.split(c, "")
    df = pairs(spark, [(1, "ab c", "ab c")])
    assert one(ng.corpus_ngram_overlap(df, 2, tokenizer=chars))["overlap"] == 1.0
