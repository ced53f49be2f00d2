"""Scores from generations, next-token scores and token log-probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .bigrams import bigram_logp

# Fixed values: (temperature, max_new_tokens) by task, and for any other task.
TASK_DEFAULTS = {"mcq": (0.0, 4), "mt": (0.0, 200), "ssg": (0.7, 100)}
OTHER_DEFAULT = (0.7, 100)


def _matches(predicted: Column, reference: Column) -> Column:
    same = F.coalesce(F.upper(predicted) == F.upper(F.trim(reference)), F.lit(False))
    return same.cast("double")


def mcq_regex_accuracy(
    df: DataFrame, generation: str = "generation", reference: str = "reference"
) -> DataFrame:
    """Adds the first stand-alone letter A-D and whether it equals the reference."""
    return df.withColumn("predicted", tx.mcq_letter(generation)).withColumn(
        "score", _matches(F.col("predicted"), F.col(reference))
    )


def mean_score(scored: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Items, hits and mean score per group."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("items"),
        F.sum(score).cast("bigint").alias("hits"),
        F.avg(score).alias("accuracy"),
    )


def logit_accuracy(
    df: DataFrame,
    letters: Mapping[str, int] | None = None,
    vocabulary: DataFrame | None = None,
    scores: str = "scores",
    reference: str = "reference",
) -> DataFrame:
    """Adds the letter with the best next-token score and whether it is right.

    ``letters`` (letter -> token id) restricts the choice, ties go to the earlier
    letter. Otherwise the best id of all is named by ``vocabulary`` (token_id,
    token), ties go to the lowest id.
    """
    if letters is not None:
        options = F.array(
            *[
                F.struct(
                    F.get(F.col(scores), F.lit(token)).alias("score"),
                    F.lit(-i).alias("earlier"),
                    F.lit(letter).alias("letter"),
                )
                for i, (letter, token) in enumerate(letters.items())
            ]
        )
        chosen = df.withColumn("predicted", F.array_max(options)["letter"])
    else:
        best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
        tokens = vocabulary.select(
            F.col("token_id").alias("__best"), F.trim("token").alias("predicted")
        )
        chosen = df.withColumn("__best", best).join(tokens, "__best", "left").drop("__best")
    return chosen.withColumn("score", _matches(F.col("predicted"), F.col(reference)))


def perplexity(
    token_scores: DataFrame,
    sequences: DataFrame | None = None,
    key: str = "seq_id",
    logprob: str = "logprob",
) -> DataFrame:
    """exp of the mean negative log-likelihood per sequence.

    ``token_scores`` holds the scored tokens (the first token of a text has none).
    Sequences of ``sequences`` without any scored token get infinity.
    """
    per_seq = token_scores.groupBy(key).agg(
        F.count(logprob).alias("scored"), F.avg(logprob).alias("__mean")
    )
    if sequences is not None:
        per_seq = sequences.select(key).distinct().join(per_seq, key, "left")
    return per_seq.select(
        key,
        F.coalesce("scored", F.lit(0)).alias("scored"),
        F.when(F.col("scored") >= 1, F.exp(-F.col("__mean")))
        .otherwise(F.lit(float("inf")))
        .alias("perplexity"),
    )


def bigram_perplexity(
    docs: DataFrame, key: str, text: str, tokenizer: tx.Tokenizer = tx.tokenize
) -> DataFrame:
    """Perplexity of each text under the add-one bigram model of all the texts.

    Texts are cut into tokens once. What is kept and shuffled is compressed: chunks of coded
    texts, the distinct words and bigrams of each chunk, and the counts that come back to it.
    """
    tokens = docs.select(F.col(key).alias("__key"), tokenizer(F.col(text)).alias("__tokens"))
    scored = (
        bigram_logp(tokens, "__key", "__tokens")
        .groupBy(F.col("__key").alias(key))
        .agg(F.sum("scored").alias("scored"), F.sum("logp").alias("__logp"))
    )
    return (
        docs.select(key)
        .join(scored, key, "left")
        .select(
            key,
            F.coalesce("scored", F.lit(0)).alias("scored"),
            F.when(F.col("scored") > 0, F.exp(-F.col("__logp") / F.col("scored")))
            .otherwise(F.lit(float("inf")))
            .alias("bigram_ppl"),
        )
    )


def generation_config(
    df: DataFrame,
    task: str = "task_type",
    temperature: Column | None = None,
    max_new_tokens: Column | None = None,
) -> DataFrame:
    """Adds temperature, max_new_tokens and do_sample; a caller's value beats the task's."""

    def default(i: int) -> Column:
        chain = F
        for name, values in TASK_DEFAULTS.items():
            chain = chain.when(F.col(task) == name, F.lit(values[i]))
        return chain.otherwise(F.lit(OTHER_DEFAULT[i]))

    temp = default(0) if temperature is None else F.coalesce(temperature, default(0))
    most = default(1) if max_new_tokens is None else F.coalesce(max_new_tokens, default(1))
    return (
        df.withColumn("temperature", temp)
        .withColumn("max_new_tokens", most)
        .withColumn("do_sample", F.col("temperature") > 0)
    )
