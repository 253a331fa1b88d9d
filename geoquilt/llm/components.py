"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step keeps connectivity and moves every vertex to a smaller neighbour; the edges end as
one star per component around its least vertex. No step gathers a vertex's neighbours: minima
are aggregated before the shuffle, and a hot vertex meets a one-row side in its join, which
adaptive execution may split. Every round is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.where("u <> v").union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of integers, in either direction, repeated or not; loops and nulls are
    ignored. Returns (u, v): each vertex that isn't the least of its component, and the least."""
    now = (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    last = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return now
        last = mark
        now = _small_star(_large_star(now)).checkpoint()
