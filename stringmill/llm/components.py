"""Connected components of a link table, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's neighbours move to the smallest node of its neighbourhood."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    # by shuffle: every broadcast table would take a page of 64 MB on the driver, round after round
    moved = both.join(least.hint("merge"), "a").select(F.col("b").alias("x"), "m", "a")
    if large:
        out = moved.where("x > a").select(F.col("x").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("x").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """a, b (any comparable type, no nulls) -> node, component: the smallest node reachable.

    Only nodes with a link to another node appear. Large-star and small-star steps alternate until
    nothing moves; each halves the distance to the smallest node, so the rounds grow with the
    logarithm of the longest chain. Every round is a written table: lost executors cost one round.
    """
    current, before = stored(links.select("a", "b").where("a <> b").distinct(), "links"), None
    while True:
        current = stored(_stars(_stars(current, True), False), "links")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # every node now hangs on the smallest of its component
    return current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
