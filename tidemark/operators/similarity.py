"""Embedding metrics: pair similarity, diversity of a group, coherence of a sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import NORM_FLOOR, cosine, norm
from .inference import embed_column
from .ngrams import explode_sentences
from ..plans.ordered import previous_row


Embed = Callable[..., DataFrame]


def pair_similarity(pairs: DataFrame, gen: str = "gen_vec", ref: str = "ref_vec") -> DataFrame:
    """Adds the cosine of the two vectors of each row."""
    return pairs.withColumn("similarity", cosine(gen, ref))


def embedding_similarity(
    pairs: DataFrame, by: Sequence[str] = (), gen: str = "gen_vec", ref: str = "ref_vec"
) -> DataFrame:
    """Mean cosine per group; 0.0 for an empty input."""
    return (
        pair_similarity(pairs, gen, ref)
        .groupBy(*by)
        .agg(
            F.count("similarity").alias("pairs"),
            F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("similarity"),
        )
    )


def embedding_diversity(df: DataFrame, by: str, vec: str, order: str) -> DataFrame:
    """One minus the mean cosine of a group's first vector to its other vectors.

    With unit vectors the mean cosine is (first . (sum - first)) / (n - 1), so one
    sum per dimension replaces a join of the group with its first member: partial
    sums shrink a hot group before anything is shuffled. ``order`` must be unique
    within a group.
    """
    rows = df.select(by, order, norm(F.col(vec)).alias("__norm"), vec).select(
        by, order, "__norm", F.posexplode(vec).alias("__dim", "__x")
    )
    per_dim = (
        rows.select(by, order, "__dim", (F.col("__x").cast("double") / F.col("__norm")).alias("__u"))
        .groupBy(by, "__dim")
        .agg(
            F.sum("__u").alias("__sum"),
            F.min_by("__u", order).alias("__first"),
            F.count("*").alias("__n"),
        )
    )
    n = F.col("members")
    return (
        per_dim.groupBy(by)
        .agg(
            F.max("__n").alias("members"),
            F.sum(F.col("__first") * (F.col("__sum") - F.col("__first"))).alias("__dot"),
        )
        .select(
            by,
            "members",
            F.when(n < 2, F.lit(0.0)).otherwise(1 - F.col("__dot") / (n - 1)).alias("diversity"),
        )
    )


def coherence(df: DataFrame, doc: str, pos: str, vec: str, block: int | Column = 1024) -> DataFrame:
    """Mean cosine of neighbouring vectors per document; 0.0 for fewer than two.

    Neighbours are found inside blocks of ``block`` positions, and a block's first
    row takes the last vector of the block before it, so one very long document
    is spread over many tasks.
    """
    bucket = F.floor(F.col(pos) / block) if isinstance(block, int) else block
    adjacent = previous_row(
        df.select(doc, pos, vec), [doc], bucket, [pos], {"__previous": F.col(vec)}
    )
    return (
        adjacent.select(doc, cosine("__previous", vec).alias("__cos"))
        .groupBy(doc)
        .agg(
            F.count("*").alias("members"),
            F.coalesce(F.avg("__cos"), F.lit(0.0)).alias("coherence"),
        )
    )


def text_similarity(
    pairs: DataFrame,
    by: Sequence[str] = (),
    cand: str = "cand",
    ref: str = "ref",
    embed: Embed = embed_column,
) -> DataFrame:
    """``embedding_similarity`` of two text columns; ``embed(df, text, out)`` adds a vector."""
    vectors = embed(embed(pairs, cand, "gen_vec"), ref, "ref_vec")
    return embedding_similarity(vectors, by)


def text_diversity(
    df: DataFrame, by: str, text: str, order: str, embed: Embed = embed_column
) -> DataFrame:
    """``embedding_diversity`` of the texts of each group."""
    return embedding_diversity(embed(df.select(by, order, text), text, "vec"), by, "vec", order)


def text_coherence(df: DataFrame, doc: str, text: str, embed: Embed = embed_column) -> DataFrame:
    """``coherence`` of the sentences of each text; a text without sentences scores 0.0.

    The sentences of a text come out of one row, one after the other, so each vector
    meets the one before it in the task that made it: the model runs once and only
    sums per document move. ``embed`` must keep rows in their order.
    """
    sentences = explode_sentences(df, doc, text)
    vectors = embed(sentences.select(doc, "pos", "sentence"), "sentence", "vec")
    kind = vectors.schema[doc].dataType.simpleString()

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_pos, last = None, None
        for batch in batches:
            sums, counts = [], []
            for at, vec in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                vec = None if vec is None else np.asarray(vec, float)
                if at and at - 1 != last_pos:
                    raise ValueError("the embedding changed the order of rows")
                sums.append(_cosine(last, vec) if at else None)
                counts.append(1)
                last_pos, last = at, vec
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())],
                names=[doc, "n", "cos"],
            )

    scored = (
        vectors.select(doc, "pos", "vec")
        .mapInArrow(pair_up, f"`{doc}` {kind}, n bigint, cos double")
        .groupBy(doc)
        .agg(F.sum("n").alias("members"), F.avg("cos").alias("coherence"))
    )
    return (
        df.select(doc)
        .join(scored, doc, "left")
        .select(
            doc,
            F.coalesce("members", F.lit(0)).alias("sentences"),
            F.coalesce("coherence", F.lit(0.0)).alias("coherence"),
        )
    )


def _cosine(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    """As ``functions.vectors.cosine``: null for a missing vector."""
    if a is None or b is None:
        return None
    length = [max(float(np.sqrt(v @ v)), NORM_FLOOR) for v in (a, b)]
    return float(a @ b) / (length[0] * length[1])
