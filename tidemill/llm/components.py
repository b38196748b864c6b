"""Connected components by star contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """links: a, b (long). Returns node, component: the smallest node that each node reaches.

    Each round links every node's larger neighbours, then its smaller ones, to the least node
    of its neighbourhood, until nothing changes; if that takes more than most_rounds, it raises an error. Rounds are written out, so lineage stays short."""
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
