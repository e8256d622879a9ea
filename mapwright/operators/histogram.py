"""Ranks and percentiles from a value histogram.

A window without a bound on its partitions would sort every row of a domain in one
task. Here rows are first reduced to distinct values with counts. Values fall into
ordered buckets by magnitude, and a bucket with many distinct values is cut into equal
ranges between its smallest and largest value. Both rules give the same buckets whenever
a lost task is run again. Running counts are taken inside the pieces; totals of pieces
are added up over a short table (see ``BUCKETS_PER_OCTAVE`` and ``PIECE_VALUES``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 64
# Distinct values a piece should hold, and the most pieces one bucket is cut into.
PIECE_VALUES, MAX_PIECES = 200_000, 100_000
_SHIFT = 1 << 21


def magnitude_bucket(v: Column) -> Column:
    """Whole number that never falls as the value grows."""
    # The cap takes the infinities into the outermost bucket.
    octave = F.floor(F.least(F.log2(F.abs(v)) * BUCKETS_PER_OCTAVE, F.lit(1e6))).cast("bigint") + _SHIFT
    return F.when(v > 0, octave).when(v < 0, -octave).otherwise(F.lit(0).cast("bigint"))


def value_histogram(df: DataFrame, groups: Sequence[str], value: str, piece_values: int = PIECE_VALUES, rows: str | None = None) -> DataFrame:
    """Per group and distinct value: ``cnt``, ``below`` (rows smaller) and ``total``.

    ``rows`` names a column that says how many rows each row stands for.
    """
    groups = list(groups)
    v = F.col(value).cast("double")
    counts = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*groups, (v + F.lit(0.0)).alias(value))
        .agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("cnt"))
        .withColumn("bucket", magnitude_bucket(F.col(value)))
    )
    shape = counts.groupBy(*groups, "bucket").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.least(F.ceil(F.count(F.lit(1)) / piece_values), F.lit(MAX_PIECES)).alias("_pieces"))
    share = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_pieces")
    piece = F.when(F.col("_pieces") > 1, F.least(F.floor(share), F.col("_pieces") - 1)).otherwise(F.lit(0))
    cut = counts.join(shape, [*groups, "bucket"]).withColumn("piece", piece.cast("bigint")).drop("_lo", "_hi", "_pieces")
    ordered = Window.partitionBy(*groups).orderBy("bucket", "piece")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*groups, "bucket", "piece").agg(F.sum("cnt").alias("in_piece"))
        .withColumn("offset", F.coalesce(F.sum("in_piece").over(before), F.lit(0)))
        .withColumn("total", F.sum("in_piece").over(Window.partitionBy(*groups)))
        .drop("in_piece")
    )
    inside = (
        Window.partitionBy(*groups, "bucket", "piece").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.join(offsets, [*groups, "bucket", "piece"])
        .withColumn("below", F.col("offset") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .select(*groups, value, "cnt", "below", "total")
    )


def attach_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Add ``cnt``, ``below`` and ``total`` to every row; null where the value is null.

    The joined side has one row per (group, value). A value shared by a large part of
    the rows is split over tasks by the adaptive skew join; rows without a value match
    nothing and are spread by a second key.
    """
    hist = value_histogram(df, groups, value)
    key = F.col(value).cast("double") + F.lit(0.0)
    left = df.withColumn("_value", F.when(~F.isnan(key), key))
    left = left.withColumn("_spread", F.when(F.col("_value").isNull(), F.monotonically_increasing_id() % 1024).otherwise(F.lit(-1).cast("bigint")))
    right = hist.withColumnRenamed(value, "_value").withColumn("_spread", F.lit(-1).cast("bigint"))
    return left.join(right, [*groups, "_value", "_spread"], "left").drop("_value", "_spread")


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float], rows: str | None = None
) -> DataFrame:
    """Linear-interpolated percentiles ``p0``, ``p1``, ... per group, in order given; ``rows`` as in ``value_histogram``."""
    groups = list(groups)
    if not groups:
        return exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probabilities, rows).drop("_all")
    hist = value_histogram(df, groups, value, rows=rows)
    below, end, v = F.col("below"), F.col("below") + F.col("cnt"), F.col(value)
    aggs = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(position), F.ceil(position)
        weight = F.max(position - low)
        at_low = F.max(F.when((below <= low) & (low < end), v))
        at_high = F.max(F.when((below <= high) & (high < end), v))
        aggs.append((at_low + (at_high - at_low) * weight).alias(f"p{i}"))
    return hist.groupBy(*groups).agg(*aggs)
