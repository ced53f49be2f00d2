"""Mixing sources to target weights, with DataFrame functions alone.

Sources in code point order, null last, take the weights in turn and share all words
by weight. A target never passes ``most`` times what its source holds; what is cut off
goes to the other sources, again by weight, until no target is above. A source's rate
is its target over its size: each of its documents is given floor(rate) times, and
once more with the probability of the fraction, drawn from a hash of seed and doc_id.

Defined results. Null or empty texts have size 0. A source of size 0 has target 0 and
rate 0. Null sources are one source. Rows that repeat a doc_id draw alike; rows with a
null doc_id all draw as one id. An empty table gives an empty result. Other columns are
carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from .names import fresh

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    totals: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3
) -> DataFrame:
    """``totals(source, source_size)`` with the column ``target``.

    Works on one row per source. In the order of cap over weight, a source stays below
    its cap once the level, what is left shared among the weights that are left, is no
    more than its own cap over weight; all later sources then do too.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = totals.select(
        "source",
        "source_size",
        F.get(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("bigint").alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    levels = ranked.select(
        "*",
        F.row_number().over(Window.orderBy(*order)).alias("at"),
        (
            (
                F.sum("source_size").over(whole)
                - F.coalesce(F.sum("cap").over(before), F.lit(0))
            )
            / F.sum("weight").over(onwards)
        ).alias("level"),
    ).withColumn("capped", F.col("cap") / F.col("weight") < F.col("level"))
    first = F.min(F.when(~F.col("capped"), F.struct("at", "level"))).over(whole)
    return levels.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * first["level"])
        .alias("target"),
    )


def draw(doc_id: str, seed: str) -> Column:
    """A number in [0, 1) that depends on seed and doc_id alone: 52 bits of their MD5."""
    text = F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    )
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10)
    return bits.cast("bigint") / F.lit(2**52)


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with one struct column ``mix(size, source_size, target, copies)``.

    Only sums per source are shuffled. They are kept as a table in the shared folder, so
    that Spark knows their size and broadcasts them only if it is small; otherwise the
    join is by source, and adaptive execution splits a hot one.
    """
    totals = docs.groupBy("source").agg(F.sum(word_count("text")).alias("source_size"))
    of_source, goal = fresh(docs, "__mix_source", "__mix")
    targets = written(source_targets(totals, weights, most), "targets").select(
        F.col("source").alias(of_source), F.struct("source_size", "target").alias(goal)
    )
    held, target = F.col(goal)["source_size"], F.col(goal)["target"]
    rate = F.when(held > 0, target / held).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (draw("doc_id", seed) < rate - whole).cast("bigint")
    joined = docs.join(targets, F.col("source").eqNullSafe(F.col(of_source)))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "mix"],
        F.struct(
            word_count("text").alias("size"),
            held.alias("source_size"),
            target.alias("target"),
            copies.alias("copies"),
        ).alias("mix"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as its copies say."""
    own, copy = fresh(docs, "__mix_own", "__copy")
    aside = docs.withColumnRenamed("mix", own)
    planned = plan_mix(aside, weights, most, seed)
    repeated = planned.select(
        *[F.col(f"`{c}`") for c in aside.columns],
        F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int"))).alias(copy),
    )
    return repeated.drop(copy).withColumnRenamed(own, "mix")
