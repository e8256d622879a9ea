"""Sizes, ranks and the best rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapwright.functions.constants import MAX_SIZE, MIN_SIZE, SIZE_STRENGTH
from mapwright.operators.histogram import attach_ranks, exact_percentiles
from mapwright.sources.storage import use_checkpoint_dir


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The limit is applied inside each task before the
    shuffle, so a group with most of the rows sends only ``n`` rows per task."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def percentile_size(
    df: DataFrame, value: str = "popularity", groups: Sequence[str] = (), low: float = MIN_SIZE,
    high: float = MAX_SIZE, strength: float = SIZE_STRENGTH,
) -> DataFrame:
    """Visual size from the average-tie percentile rank; a missing value gets ``low``."""
    extra = [] if groups else ["_all"]
    base = df if groups else df.withColumn("_all", F.lit(1))
    ranked = attach_ranks(base, list(groups) or ["_all"], value)
    pct = (F.col("below") + (F.col("cnt") + 1) / 2) / F.col("total")
    size = F.lit(low) + F.pow(F.coalesce(pct, F.lit(0.0)), strength) * (high - low)
    return ranked.withColumn("visual_size", F.greatest(F.lit(low), F.least(F.lit(high), size))).drop(
        "cnt", "below", "total", *extra)


def min_max_size(df: DataFrame, value: str, strength: float = SIZE_STRENGTH) -> DataFrame:
    """Older size rule: min-max scale, power, times 50, at least 2; constant input gives 5."""
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    out = df.withColumn("_b", bounds)
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    scaled = F.greatest(F.pow((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)), strength) * 50, F.lit(2.0))
    return out.withColumn("visual_size", F.when(hi == lo, F.lit(5.0)).otherwise(scaled)).drop("_b")


def descending_rank(df: DataFrame, groups: Sequence[str], value: str, prefix: str) -> DataFrame:
    """1 + number of strictly greater values in the group, and that as a top percent."""
    ranked = attach_ranks(df, groups, value)
    rank = F.col("total") - F.col("below") - F.col("cnt") + 1
    return ranked.withColumn(f"{prefix}_rank", rank).withColumn(
        f"{prefix}_top_percent", rank / F.col("total") * 100).drop("cnt", "below", "total")


def ascending_rank(df: DataFrame, groups: Sequence[str], value: str, prefix: str) -> DataFrame:
    """1 + number of strictly smaller values in the group, and that as a top percent."""
    ranked = attach_ranks(df, groups, value)
    rank = F.col("below") + 1
    return ranked.withColumn(f"{prefix}_rank", rank).withColumn(
        f"{prefix}_top_percent", rank / F.col("total") * 100).drop("cnt", "below", "total")


def balanced_domains(df: DataFrame, score: Column, domain: str = "domain") -> DataFrame:
    """From each domain the ``m`` most popular items, ``m`` being the smallest domain.

    The kept number can be large, so places come from the histogram; only the ties at
    the cut are ordered, by hashed id.
    """
    smallest = df.groupBy(domain).count().agg(F.min("count")).scalar()
    ranked = attach_ranks(df.withColumn("_score", score), [domain], "_score")
    better = F.col("total") - F.col("below") - F.col("cnt")
    ranked = ranked.withColumn("_better", better).withColumn("_m", smallest).withColumn("_hash", F.md5("id"))
    sure = ranked.where(F.col("_better") + F.col("cnt") <= F.col("_m"))
    edge = ranked.where((F.col("_better") < F.col("_m")) & (F.col("_better") + F.col("cnt") > F.col("_m")))
    # Ties at the cut share one score per domain: place them by id through buckets of
    # the hashed id, so that no single task orders all of them.
    edge = edge.withColumn("_bucket", F.substring("_hash", 1, 3))
    ahead = Window.partitionBy(domain).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = edge.groupBy(domain, "_bucket").count().withColumn(
        "_ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    inside = Window.partitionBy(domain, "_bucket").orderBy("_hash", "id")
    cut = edge.join(sizes, [domain, "_bucket"]).withColumn(
        "_place", F.col("_ahead") + F.row_number().over(inside)).where("_place <= _m - _better")
    return sure.select(*df.columns).unionByName(cut.select(*df.columns))


def size_quantile_levels(df: DataFrame, size: str = "visual_size") -> DataFrame:
    """Level of detail per item: 'far' keeps the top 15 %, 'middle' the top 65 %, 'near' the
    top 75 % of what 'middle' kept."""
    first = exact_percentiles(df, [], size, [0.85, 0.35]).select(F.struct("p0", "p1")).scalar()
    out = df.withColumn("_q", first)
    middle = out.where(F.col(size) >= F.col("_q.p1"))
    near = exact_percentiles(middle, [], size, [0.25]).scalar()
    return out.withColumn("far", F.col(size) >= F.col("_q.p0")).withColumn(
        "middle", F.col(size) >= F.col("_q.p1")).withColumn(
        "near", F.col("middle") & (F.col(size) >= near)).drop("_q")


def places(df: DataFrame, *order: str) -> DataFrame:
    """Add ``place``, 1, 2, ... in the order given, without one task that sees all rows.

    Rows are sorted in ranges and stored; the place in a range and the sizes of the ranges before it make the number.
    The order should be unique.
    """
    use_checkpoint_dir(df.sparkSession)
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(number, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range, as many as there are shuffle partitions.
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = ranged.join(F.broadcast(starts.drop("_n")), "_part")
    return joined.withColumn("place", F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_before")
