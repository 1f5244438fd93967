"""Connected components in DataFrames, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, written


def components(spark: SparkSession, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): for each node of `links` (a, b) the least node that it reaches.

    In a round each node passes the least of its neighbours and itself to its larger neighbours, then to its
    smaller ones; what remains are stars. Minima are partial sums, so a node with a third of all links
    is one row for each task; the joins split skewed keys. Each round is written to the shared folder. With
    `rounds` it stops after so many: a component is then some node that the node reaches, the least one or not.
    """
    edges, last, before = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None, None
    for i in range(rounds or 60):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        joined = larger.join(larger.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = written(spark, joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "round")
        if last is not None:
            discard(spark, last)
        last = edges
        if rounds is None and i:
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
    else:
        if rounds is None:
            raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    ends = edges.select(F.col("v").alias("u")).distinct().join(stars.select("u"), "u", "left_anti") if rounds else edges.select(F.col("v").alias("u")).distinct()
    return stars.select(F.col("u").alias("node"), "component").unionByName(ends.select(F.col("u").alias("node"), F.col("u").alias("component")))
