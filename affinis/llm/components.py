"""Connected components of an edge table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from affinis.llm.store import settle


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the smallest node of the component.

    Each round is two partially aggregated shuffles; rounds grow with the logarithm of the longest path. Every
    round is written to the shared folder. Edges that point at themselves are ignored.
    """
    e = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while (now := _print_of(e)) != before:
        before = now
        # Large star: larger neighbours of u point at the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = settle(e, "edges")
        # Small star: u and its smaller neighbours point at the smallest of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = settle(e, "edges")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.unionByName(roots)
