"""Connected components of links between numbers, as joins and minima in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written


def _state(edges: DataFrame) -> tuple:
    """A number that tells one set of edges from another."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "m").cast("decimal(38,0)")).alias("sum"),
    ).first()
    return row["n"], row["sum"]


def near_labels(links: DataFrame) -> DataFrame:
    """``links(a, b)`` as (node, component), two steps only.

    Nodes of one label are connected; connected nodes may have different labels. Enough
    to leave out pairs that need no further link, at the price of one sum and one join.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = written(
        both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")),
        "labels",
    )
    again = low.select(F.col("a").alias("low"), F.col("low").alias("lower"))
    return low.join(again, "low").select(F.col("a").alias("node"), F.col("lower").alias("component"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` as (node, component): the smallest node each one can reach.

    Alternates two steps until nothing changes: every larger neighbour of a node is tied to
    the smallest node in its neighbourhood, then every smaller one. Paths shorten by half
    or better each round, and what is left is a star around each component's smallest
    node. Each round is written to the shared folder.
    """
    edges = links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")
    )
    edges = written(edges.distinct(), "links")
    before = _state(edges)
    for _ in range(rounds):
        both = edges.select("u", F.col("m").alias("v")).union(
            edges.select(F.col("m").alias("u"), F.col("u").alias("v"))
        )
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), "m")
        lowest = tied.groupBy("u").agg(F.min("m").alias("low"))
        again = tied.join(lowest, "u")
        edges = written(
            again.select(F.col("m").alias("u"), F.col("low").alias("m"))
            .union(again.select("u", F.col("low").alias("m")))
            .filter("u <> m")
            .distinct(),
            "links",
        )
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("m").alias("component"))
    return stars.union(
        stars.select(F.col("component").alias("node"), "component").distinct()
    )
