"""Density clusters of many densities: a tree of the neighbour graph's levels, cut by stability.

The core distance of a point is the distance to its ``min_samples``-th neighbour, and two neighbours are joined at the
larger of their core distances, which is their mutual reachability. Clusters at a level are the connected points whose
core distance is within it. Each point leads to its neighbour of least core distance, so the points fall into basins;
a point is connected to the bottom of its basin at every level at which it is there at all. So the basins and the lowest
passes between them hold the whole tree, with far fewer nodes than points, and all levels are joined in the same rounds.
Joins run along the neighbour lists; parts of the map that no list connects are separate at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapwright.operators.histogram import exact_percentiles
from mapwright.operators.neighbors import knn_lists
from mapwright.sources.storage import written


def basins(cores: DataFrame, lists: DataFrame) -> DataFrame:
    """``id``, ``n``, ``level`` and ``basin`` (the id of the bottom) of every point; ``at`` orders points by core distance and id.

    Each round replaces a point's step by the step of the point it leads to, so a way of any length takes its logarithm
    in rounds. A point below all of its neighbours is a bottom.
    """
    to = cores.select(F.col("id").alias("rid"), F.col("at").alias("low"))
    lowest = lists.select("id", F.explode("near").alias("rid")).join(to, "rid").groupBy("id").agg(F.min("low").alias("low"))
    steps = cores.join(lowest, "id", "left").select("id", "n", "level", "at", F.least("at", "low").alias("low"))
    steps = written(steps, "steps")
    while True:
        further = steps.select(F.col("at").alias("low"), F.col("low").alias("next"), F.col("id").alias("basin"))
        moved = written(steps.join(further, "low").select("id", "n", "level", "at", "low", "next", "basin"), "steps")
        if not moved.where("next <> low").limit(1).count():
            return moved.select("id", "n", "level", "basin")
        steps = moved.select("id", "n", "level", "at", F.col("next").alias("low"))


def passes(points: DataFrame, lists: DataFrame) -> DataFrame:
    """The lowest level at which two basins meet: ``a``, ``b`` and ``first``, each pair once."""
    left = lists.join(points, "id").select("basin", "level", F.explode("near").alias("rid"))
    right = points.select(F.col("id").alias("rid"), F.col("basin").alias("to"), F.col("level").alias("to_level"))
    both = left.join(right, "rid").where(F.col("basin") != F.col("to"))
    return both.groupBy(F.least("basin", "to").alias("a"), F.greatest("basin", "to").alias("b")).agg(
        F.min(F.greatest("level", "to_level")).alias("first"))


def joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``label``, the least basin of the connected group, of each node (level, basin); edges are (level, a, b) both ways.

    Each round hooks every node to its least neighbour where that is less, shortens the ways twice and keeps the edges
    between what is left, so edges and nodes shrink by a factor a round; all levels share the rounds.
    """
    labels = nodes.select("level", "basin", F.col("basin").alias("label"))
    while edges.limit(1).count():
        hooks = edges.groupBy("level", "a").agg(F.min("b").alias("to")).where("to < a")
        for _ in range(2):
            further = hooks.select("level", F.col("a").alias("to"), F.col("to").alias("next"))
            hooks = written(hooks.join(further, ["level", "to"], "left").select("level", "a", F.coalesce("next", "to").alias("to")), "hooks")

        def follow(df: DataFrame, c: str, hooks: DataFrame = hooks) -> DataFrame:
            step = hooks.withColumnsRenamed({"a": c, "to": "_to"})
            return df.join(step, ["level", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")

        labels = follow(labels, "label")
        edges = written(follow(follow(edges, "a"), "b").where("a <> b").select("level", "a", "b").distinct(), "edges")
    return written(labels, "labels")


def level_heights(cores: DataFrame, levels: int) -> list[float]:
    """Core distances that the shares 1/levels, 2/levels, ... of the points lie within; equal ones count once."""
    row = exact_percentiles(cores, [], "core", [(i + 1) / levels for i in range(levels)], "n").first()
    return sorted({v for v in row if v is not None}) if row else []


def gains(heights: list[float]) -> list[float]:
    """What a point adds to its cluster's stability at each level: the fall of 1/height to the next one; none at the last.

    A height of zero (points that share a place) counts as half of the next height.
    """
    positive = [h for h in heights if h > 0]
    floor = positive[0] / 2 if positive else 1.0
    inverse = [1 / max(h, floor) for h in heights]
    return [a - b for a, b in zip(inverse, inverse[1:], strict=False)] + [0.0] * bool(heights)


def cluster_tree(labels: DataFrame, counts: DataFrame, gain: list[float], min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """Branches of the tree, and which branch lies above which.

    A branch (``level``, ``label`` of its widest group) goes on through the levels as long as one group of
    ``min_cluster_size`` points or more comes out of it; ``own`` is its stability and ``size`` its points. The second
    table holds (level, label, up_level, up_label) for all branches above one.
    """
    inside = Window.partitionBy("basin").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    there = labels.join(counts, ["basin", "level"], "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(inside))
    groups = there.groupBy("level", "label").agg(F.sum("n").alias("size")).where(F.col("size") >= min_cluster_size)
    groups = written(groups, "groups")
    above = labels.select((F.col("level") - 1).alias("level"), F.col("basin").alias("label"), F.col("label").alias("up"))
    tied = groups.join(above, ["level", "label"], "left")
    siblings = tied.where("up IS NOT NULL").groupBy("level", "up").agg(F.count(F.lit(1)).alias("siblings"))
    heads = written(tied.join(siblings, ["level", "up"], "left").where("up IS NULL OR siblings > 1").select("level", "label"), "heads")
    # Every group beside the heads among itself and the groups that hold it, at most one a level.
    over = labels.select(F.col("level").alias("up_level"), F.col("basin").alias("label"), F.col("label").alias("up_label"))
    tops = heads.select(F.col("level").alias("up_level"), F.col("label").alias("up_label"))
    held = written(groups.join(over, "label").where("up_level >= level").join(tops, ["up_level", "up_label"]), "held")
    head = held.groupBy("level", "label", "size").agg(F.min(F.struct("up_level", "up_label")).alias("h"))
    weight = F.array(*[F.lit(g) for g in gain])[F.col("level")]
    branches = head.groupBy(F.col("h.up_level").alias("level"), F.col("h.up_label").alias("label")).agg(
        F.sum(F.col("size") * weight).alias("own"), F.max("size").alias("size"))
    lines = held.join(heads, ["level", "label"]).where("up_level > level").select("level", "label", "up_level", "up_label")
    return written(branches, "branches"), written(lines, "lines")


def stable_branches(branches: DataFrame, lines: DataFrame, largest: int) -> DataFrame:
    """Branches that are as stable as all chosen ones below them together, the highest of them; ``size`` at most ``largest``.

    Goes from the deepest branches up: as many steps as splits above one another, at most one a level.
    """
    parent = lines.groupBy("level", "label").agg(F.count(F.lit(1)).alias("depth"), F.min(F.struct("up_level", "up_label")).alias("p"))
    tree = written(branches.join(parent, ["level", "label"], "left").select(
        "level", "label", "own", "size", F.coalesce("depth", F.lit(0)).alias("depth"), "p.up_level", "p.up_label"), "tree")
    deepest = tree.agg(F.max("depth")).first()[0]
    chosen = []
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = tree.where(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("sub", F.lit(0.0))
        else:
            sums = below.groupBy(F.col("up_level").alias("level"), F.col("up_label").alias("label")).agg(F.sum("total").alias("sub"))
            here = here.join(sums, ["level", "label"], "left").na.fill(0.0, ["sub"])
        keep = (F.col("size") <= largest) & (F.col("own") >= F.col("sub"))
        below = written(here.withColumn("keep", keep).withColumn("total", F.when(F.col("keep"), F.col("own")).otherwise(F.col("sub"))), "depth")
        chosen.append(below.where("keep").select("level", "label", "size"))
    if not chosen:
        return branches.select("level", "label", "size")
    kept = chosen[0]
    for more in chosen[1:]:
        kept = kept.unionByName(more)
    kept = written(kept, "kept")
    covered = lines.join(kept.select(F.col("level").alias("up_level"), F.col("label").alias("up_label")), ["up_level", "up_label"])
    return kept.join(covered.select("level", "label").distinct(), ["level", "label"], "left_anti")


def density_tree_clusters(items: DataFrame, min_cluster_size: int = 150, min_samples: int = 20, levels: int = 32, allow_single: bool = False) -> DataFrame:
    """Add ``cluster`` (-1: noise) to items with a text ``id`` (one row each), ``x`` and ``y``.

    ``levels`` is the resolution of the tree, in equal shares of the points. A group of all points is no cluster unless
    ``allow_single``. Clusters are numbered by size, ties by level and bottom. A null or non-finite coordinate, or fewer
    than ``min_samples`` other points, makes noise.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    usable = items.where(finite[0] & finite[1] & F.col("id").isNotNull()).select("id", "x", "y")
    # Whole numbers in the order of the ids stand for them from here on.
    ordered = written(usable.orderBy("id").select(F.monotonically_increasing_id().alias("id"), "x", "y"), "ordered")
    # All points of a place have one core distance and are linked at it, and a list that holds any of them holds the least:
    # that one stands for its place.
    places = written(ordered.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "places")
    asks = places.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.lit("all").alias("part"))
    refs = ordered.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.lit("all").alias("part"))
    found = knn_lists(asks, refs, min_samples).where(F.size("near") == min_samples)
    lists = written(found.select(F.col("qid").alias("id"), F.sqrt(F.col("near")[min_samples - 1]["d2"]).alias("core"), F.col("near.rid").alias("near")), "lists")
    cores = lists.select("id", "core").join(places.select("id", "n"), "id")
    cores = written(cores.orderBy("core", "id").withColumn("at", F.monotonically_increasing_id()), "cores")
    heights = level_heights(cores, levels)
    if not heights:
        return items.withColumn("cluster", F.lit(-1))
    level = F.size(F.filter(F.array(*[F.lit(h) for h in heights]), lambda h: h < F.col("core")))
    points = basins(cores.withColumn("level", level), lists)
    met = passes(points, lists)
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "first"))
    last = F.lit(len(heights) - 1)
    edges = written(both.select("a", "b", F.explode(F.sequence(F.col("first"), last)).alias("level")), "edges")
    bottoms = points.where("id = basin").select("basin", F.col("level").alias("first"))
    nodes = written(bottoms.select("basin", F.explode(F.sequence(F.col("first"), last)).alias("level")), "nodes")
    labels = joined(nodes, edges)
    counts = points.groupBy("basin", "level").agg(F.sum("n").alias("n"))
    branches, lines = cluster_tree(labels, counts, gains(heights), min_cluster_size)
    found = stable_branches(branches, lines, cores.agg(F.sum("n")).first()[0] - (not allow_single))
    # One row per cluster, far fewer than points: a plain window numbers them.
    numbered = found.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("size"), "level", "label")) - 1)
    members = labels.join(numbered.select("level", "label", "cluster"), ["level", "label"]).select("basin", F.col("level").alias("widest"), "cluster")
    placed = points.join(members, "basin").where("level <= widest").select("id", "cluster").join(places, "id").select("x", "y", "cluster")
    out = items.join(placed, ["x", "y"], "left").withColumn("cluster", F.coalesce(F.when(F.col("id").isNotNull(), F.col("cluster")), F.lit(-1)))
    return out.select("id", *[c for c in items.columns if c != "id"], "cluster")
