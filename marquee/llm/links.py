"""Components of pairs (x, y) of 64-bit keys, found on Spark.

A table of labels (k, label) has a row for every key that is linked with
another; the label is the smallest key reachable. New pairs are first replaced
by the labels of their ends, so later rounds only work on what they join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.frames import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on edges (x, y), y < x."""
    both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))) if large else edges
    least = both.groupBy("x").agg(F.min("y").alias("low")).withColumn("low", F.least("x", "low"))
    rows = both.join(least, "x")
    if large:
        out = rows.filter("y > x").select(F.col("y").alias("x"), F.col("low").alias("y"))
    else:
        out = rows.filter("y <> low").select(F.col("y").alias("x"), F.col("low").alias("y"))
        out = out.union(least.select("x", F.col("low").alias("y")))
    return out.filter("x <> y").distinct()


def components(links: DataFrame) -> DataFrame:
    """(k, label) of every linked key, by large-star and small-star rounds."""
    edges = links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    while True:
        edges = written(_starred(_starred(edges, True), False), "links")
        # Done when every key either has one smaller neighbour or is one.
        ends = edges.select(F.col("x").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("y", F.lit(0), F.lit(1)))
        ends = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up + down > 1").isEmpty():
            return edges.select(F.col("x").alias("k"), F.col("y").alias("label")).union(
                edges.select(F.col("y").alias("k"), F.col("y").alias("label")).distinct())


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels with new links (x, y), a written table, added."""
    if labels is None:
        return written(components(links), "labels")
    one = labels.select(F.col("k").alias("x"), F.col("label").alias("a"))
    two = labels.select(F.col("k").alias("y"), F.col("label").alias("b"))
    pairs = links.join(one, "x", "left").join(two, "y", "left").select(
        F.coalesce("a", "x").alias("x"), F.coalesce("b", "y").alias("y")).filter("x <> y").distinct()
    pairs = written(pairs, "label_pairs")
    if pairs.isEmpty():
        return labels
    roots = components(pairs)
    moved = labels.join(roots.select(F.col("k").alias("label"), F.col("label").alias("to")), "label", "left")
    fresh = roots.join(labels.select("k"), "k", "left_anti")
    return written(moved.select("k", F.coalesce("to", "label").alias("label")).unionByName(fresh.select("k", "label")), "labels")
