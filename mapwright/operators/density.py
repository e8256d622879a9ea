"""Density clusters on the map from a grid of cells.

The grid is set by the data: as many cells as make a neighbourhood of nine hold ``min_samples`` items on average over
the middle of the map, times ``contrast``. A cell is dense by its share of the items, so the same shape gives the same
clusters whatever the number of rows; far outliers do not widen the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapwright.operators.histogram import exact_percentiles
from mapwright.sources.storage import written

#: Share of the items left out on either side when the map's extent is taken.
TAIL = 0.01


def to_cells(items: DataFrame, min_samples: int, contrast: float) -> DataFrame:
    """Items with their cell on a square grid."""
    long = items.select(F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))).alias("p")).select("p.*")
    cuts = exact_percentiles(long, ["axis"], "v", [TAIL, 1 - TAIL])
    span = cuts.agg(F.struct(
        F.max(F.when(F.col("axis") == "x", F.col("p0"))).alias("x0"), F.max(F.when(F.col("axis") == "y", F.col("p0"))).alias("y0"),
        F.max(F.col("p1") - F.col("p0")).alias("span"))).scalar()
    count = items.agg(F.count(F.lit(1))).scalar()
    out = items.withColumn("_b", span)
    side = F.when(F.col("_b.span") > 0, F.col("_b.span") / F.greatest(F.lit(1.0), F.floor(F.sqrt(count * F.lit(9.0 / (contrast * min_samples)))))).otherwise(F.lit(1.0))
    return out.withColumn("cx", F.floor((F.col("x") - F.col("_b.x0")) / side)).withColumn(
        "cy", F.floor((F.col("y") - F.col("_b.y0")) / side)).drop("_b")


def components(cells: DataFrame) -> DataFrame:
    """Connected groups among cells (cx, cy), eight neighbours each; ``label`` is the
    smallest cell number of the group.

    Each round takes the smallest label around a cell and then jumps to that label's own
    label, so long shapes settle in few rounds; rounds go on until nothing changes. They
    are written as tables: lineage stays short, a lost executor costs one round, and sizes
    are those of the files. (A checkpoint keeps the estimate of the joins behind it, whose
    digits double each round until the driver cannot hold them.)
    """
    number = F.col("cx") * F.lit(1 << 31).cast("bigint") + F.col("cy")
    nodes = written(cells.select("cx", "cy", number.alias("cell")), "cells")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    around = nodes.select("cell", "cx", "cy", F.explode(steps).alias("s"))
    far = (F.col("cx") + F.col("s.dx")) * F.lit(1 << 31).cast("bigint") + F.col("cy") + F.col("s.dy")
    edges = written(around.select("cell", far.alias("other")).join(nodes.select(F.col("cell").alias("other")), "other"), "cell-edges")
    labels = nodes.select("cell", F.col("cell").alias("label"))
    while True:
        seen = edges.join(labels.withColumnRenamed("cell", "other"), "other").groupBy("cell").agg(F.min("label").alias("m"))
        step = labels.join(seen, "cell", "left").select("cell", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        jump = step.select(F.col("cell").alias("next"), F.col("next").alias("jump"))
        moved = written(step.join(jump, "next").select("cell", "label", F.least("next", "jump").alias("next")), "cell-labels")
        changed = moved.where("label <> next").limit(1).count()
        labels = moved.select("cell", F.col("next").alias("label"))
        if not changed:
            return labels.join(nodes, "cell")


def density_clusters(items: DataFrame, min_cluster_size: int = 150, min_samples: int = 20, contrast: float = 1.0) -> DataFrame:
    """Add ``cluster``: dense neighbouring cells form a cluster, the rest is noise (-1).

    A cell is dense when it and its eight neighbours hold ``min_samples`` items; ``contrast``
    is how many times the average density that is. Clusters are numbered by size, ties by
    their smallest cell.
    """
    placed = to_cells(items, min_samples, contrast)
    counts = placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    spread = counts.withColumn("s", F.explode(steps)).select(
        (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), "n")
    mass = spread.groupBy("cx", "cy").agg(F.sum("n").alias("mass"))
    dense = counts.join(mass, ["cx", "cy"]).where(F.col("mass") >= min_samples)
    groups = components(dense.select("cx", "cy")).join(counts, ["cx", "cy"])
    sizes = groups.groupBy("label").agg(F.sum("n").alias("size")).where(F.col("size") >= min_cluster_size)
    # One row per surviving group, far fewer than cells: a plain window numbers them.
    numbered = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1)
    cells = groups.select("cx", "cy", "label").join(numbered.select("label", "cluster"), "label").select("cx", "cy", "cluster")
    return placed.join(cells, ["cx", "cy"], "left").na.fill(-1, ["cluster"]).drop("cx", "cy")
