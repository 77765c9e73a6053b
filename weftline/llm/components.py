"""Connected components of a graph given as links, by alternating large and small stars, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours move to the least of it and its neighbours. Small: its smaller ones and itself do.

    links are (a, b) with a > b, possibly more than once. Each star is one shuffle by its centre.
    """
    sides = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))) if large else links
    least = sides.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    if large:
        return least.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return least.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether each node has one link to a least node that itself has none."""
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top")))))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 or up + top > 1").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node with a link; links are (a, b), a component is named by its least node.

    Each round is written to the shared folder, so a lost executor costs one round. The number of rounds grows with the
    logarithm of the longest chain. Null ends and loops are ignored; no links give no rows.
    """
    now = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_forest_of_stars(now):
        now = materialise(_stars(_stars(now, True), False).distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
