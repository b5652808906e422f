"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudline.llm.work import settle

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b); root is the smallest id of the component.

    Every node hangs its larger neighbours, then its smaller ones, below its smallest neighbour, until each
    component is a star.  Smallest neighbours are partial aggregates, and rows go back to them by join, so a node
    with very many neighbours is never one group.  No links are collected.
    """
    stars = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        stars = settle(small.filter("a <> b").distinct(), "stars")
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
