"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``root`` for every node of an edge; the root is the smallest node of its component.

    Edges are columns ``u`` and ``v``. A round links larger neighbours to the smallest node around (large star), then
    smaller ones (small star); it ends when a round changes nothing. Neighbourhoods are never gathered: the smallest
    neighbour is an aggregate that is joined back. A round is written once, so a lost executor costs no earlier round. Links
    to oneself and null ends are left out; repeated links count once; without links the result is empty.
    """
    # Links are few and narrow beside the documents: as many tasks as run at once write fewer and larger shuffle files.
    tasks = edges.sparkSession.sparkContext.defaultParallelism
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
    edges = stored(edges, "component-links")
    before = None
    while True:
        pairs = _both(edges)
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").coalesce(tasks)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct().coalesce(tasks), "component-links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        before = state


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """``u`` and ``root`` after more links: only the components they join are looked at again."""
    ends = links.join(label.select("u", F.col("root").alias("a")), "u", "left").join(label.select(F.col("u").alias("v"), F.col("root").alias("b")), "v", "left")
    between = ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    joined = stored(components(between).select(F.col("u").alias("root"), F.col("root").alias("least")), "component-joins")
    moved = label.join(joined, "root", "left").select("u", F.coalesce("least", "root").alias("root"))
    return moved.unionByName(joined.select(F.col("root").alias("u"), F.col("least").alias("root")).join(label.select("u"), "u", "left_anti"))
