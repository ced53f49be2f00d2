"""Corpus n-gram metrics: overlap, BLEU, diversity; and the exploded forms of the text functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.ordered import spread_by

# Fixed value: smoothing inside the logarithm of a precision.
BLEU_EPSILON = 1e-9


def explode_tokens(
    df: DataFrame, key: str, text: str, tokenizer: tx.Tokenizer = tx.tokenize
) -> DataFrame:
    """One row per token: (key, pos, token)."""
    return _exploded(df.select(key, tokenizer(F.col(text)).alias("__items")), key, "token")


def _exploded(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, pos, item) of the arrays ``__items``.

    Of an inner explode Spark infers that its array is not empty, and works the array out
    twice to filter by it early; so empty ones go afterwards.
    """
    rows = df.select(key, F.posexplode_outer("__items").alias("pos", item))
    return rows.filter(F.col("pos").isNotNull())


def explode_ngrams(
    df: DataFrame, key: str, text: str, n: int = 2, tokenizer: tx.Tokenizer = tx.tokenize
) -> DataFrame:
    """One row per n-gram: (key, pos, gram array).

    The tokens are laid beside themselves, moved by one place each time, and exploded together:
    a gram becomes an array only where it is a row.
    """
    tokens = df.select(F.col(key).alias("__key"), tokenizer(F.col(text)).alias("__0"))
    if n <= 0:
        return _exploded(tokens.select("__key", tx.ngrams("__0", n).alias("__items")), "__key", "gram").withColumnRenamed("__key", key)
    starts = F.greatest(F.size("__0") - (n - 1), F.lit(0))
    moved = [F.slice("__0", F.lit(i + 1), starts).alias(f"__{i}") for i in range(n)]
    names = [f"__{i}" for i in range(n)]
    laid = tokens.select("__key", *moved).select("__key", F.arrays_zip(*names).alias("__items"))
    return _exploded(laid, "__key", "__gram").select(F.col("__key").alias(key), "pos", F.array(*[f"__gram.{c}" for c in names]).alias("gram"))


def explode_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: (key, pos, sentence)."""
    return _exploded(df.select(key, tx.split_sentences(text).alias("__items")), key, "sentence")


def _side(which: str, tokens: str, orders: Sequence[int], escape: bool) -> list[Column]:
    return [
        F.struct(
            F.lit(which == "cand").alias("is_cand"),
            F.lit(n).alias("n"),
            tx.gram_keys(tokens, n, escape).alias("grams"),
        )
        for n in orders
    ]


def clipped_counts(
    pairs: DataFrame,
    orders: Sequence[int],
    key: str = "pair_id",
    cand: str = "cand",
    ref: str = "ref",
    by: Sequence[str] = (),
    tokenizer: tx.Tokenizer = tx.tokenize,
) -> DataFrame:
    """Per (``by``, n): clipped matches and the n-gram totals of both sides.

    The texts are spread by their unique key once. The n-grams of a pair then
    already sit together, so counting them moves nothing; only one row per
    (``by``, n) and task is shuffled afterwards.
    """
    escape = tokenizer is not tx.tokenize
    sides = (
        spread_by(pairs.select(*by, key, cand, ref), key)
        .select(
            *by,
            key,
            tokenizer(F.col(cand)).alias("cand_tokens"),
            tokenizer(F.col(ref)).alias("ref_tokens"),
        )
        .select(
            *by,
            key,
            F.inline(
                F.array(
                    *_side("cand", "cand_tokens", orders, escape),
                    *_side("ref", "ref_tokens", orders, escape),
                )
            ),
        )
    )
    counts = (
        sides.select(*by, key, "is_cand", "n", F.explode("grams").alias("gram"))
        .groupBy(*by, key, "n", "gram")
        .agg(F.count_if("is_cand").alias("c"), F.count_if(~F.col("is_cand")).alias("r"))
    )
    return counts.groupBy(*by, "n").agg(
        F.sum(F.least("c", "r")).alias("matches"),
        F.sum("c").alias("cand_total"),
        F.sum("r").alias("ref_total"),
    )


def corpus_ngram_overlap(pairs: DataFrame, n: int = 2, by: Sequence[str] = (), **columns) -> DataFrame:
    """Clipped matches over reference n-grams, pooled over all pairs (or per ``by``)."""
    pooled = clipped_counts(pairs, [n], by=by, **columns).groupBy(*by).agg(
        F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"),
        F.coalesce(F.sum("ref_total"), F.lit(0)).alias("ref_total"),
    )
    return pooled.withColumn(
        "overlap",
        F.when(F.col("ref_total") > 0, F.col("matches") / F.col("ref_total")).otherwise(F.lit(0.0)),
    )


def corpus_bleu(pairs: DataFrame, max_n: int = 4, by: Sequence[str] = (), **columns) -> DataFrame:
    """BLEU from pooled counts: every order 1..max_n enters the mean, a missing one as 0."""
    pooled = clipped_counts(pairs, range(1, max_n + 1), by=by, **columns)

    def at(n: int, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == n, F.col(column))), F.lit(0))

    wide = pooled.groupBy(*by).agg(
        at(1, "cand_total").alias("cand_len"),
        at(1, "ref_total").alias("ref_len"),
        *[at(n, "matches").alias(f"__m{n}") for n in range(1, max_n + 1)],
        *[at(n, "cand_total").alias(f"__t{n}") for n in range(1, max_n + 1)],
    )
    logs = [
        F.ln(
            F.when(F.col(f"__t{n}") > 0, F.col(f"__m{n}") / F.col(f"__t{n}")).otherwise(F.lit(0.0))
            + BLEU_EPSILON
        )
        for n in range(1, max_n + 1)
    ]
    mean_log = sum(logs[1:], logs[0]) / max_n
    penalty = F.when(F.col("cand_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("ref_len") / F.greatest(F.col("cand_len"), F.lit(1)))
    )
    empty = (F.col("cand_len") == 0) & (F.col("ref_len") == 0)
    return wide.select(
        *by,
        "cand_len",
        "ref_len",
        F.when(empty, F.lit(0.0)).otherwise(penalty * F.exp(mean_log)).alias("bleu"),
    )


def ngram_diversity(
    df: DataFrame, key: str, text: str, n: int = 2, tokenizer: tx.Tokenizer = tx.tokenize
) -> DataFrame:
    """Distinct over total n-grams per row."""
    tokens = df.select(key, tokenizer(F.col(text)).alias("tokens"))
    grams = tokens.select(
        key, tx.gram_keys("tokens", n, tokenizer is not tx.tokenize).alias("grams")
    )
    return grams.select(key, tx.distinct_ratio("grams").alias("diversity"))


def corpus_ngram_diversity(
    df: DataFrame,
    by: Sequence[str],
    text: str,
    n: int = 2,
    approximate: bool = False,
    tokenizer: tx.Tokenizer = tx.tokenize,
) -> DataFrame:
    """Distinct over total n-grams of all texts in a group.

    Exact form: counts per (group, n-gram) first, so a group that holds a third
    of the corpus is spread by its n-grams. ``approximate`` keeps a sketch instead.
    """
    grams = df.select(*by, tokenizer(F.col(text)).alias("tokens")).select(
        *by,
        F.explode_outer(tx.gram_keys("tokens", n, tokenizer is not tx.tokenize)).alias("gram"),
    )
    if approximate:
        counted = grams.groupBy(*by).agg(
            F.approx_count_distinct("gram").alias("distinct_grams"), F.count("gram").alias("total_grams")
        )
    else:
        counted = (
            grams.groupBy(*by, "gram")
            .agg(F.count("gram").alias("c"))
            .groupBy(*by)
            .agg(F.count("gram").alias("distinct_grams"), F.sum("c").alias("total_grams"))
        )
    return counted.withColumn(
        "diversity",
        F.when(F.col("total_grams") > 0, F.col("distinct_grams") / F.col("total_grams")).otherwise(
            F.lit(0.0)
        ),
    )
