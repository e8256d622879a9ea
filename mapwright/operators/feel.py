"""Feel dimensions: anchors, scores, scaling, traits and statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapwright.functions.constants import FEEL_AXES, FEEL_DIMENSIONS
from mapwright.functions.values import signed_text
from mapwright.operators.histogram import exact_percentiles
from mapwright.operators.ranking import top_per_group

AXIS = {a[0]: a for a in FEEL_AXES}
N_ANCHORS = sum(1 if a[2] is None else 2 for a in FEEL_AXES)


def anchor_table(spark: SparkSession) -> DataFrame:
    """The 23 anchor sentences: two per two-ended axis, one per one-ended axis."""
    rows = []
    for dim, high, low, high_text, low_text in FEEL_AXES:
        if low is None:
            rows.append((len(rows), f"{dim}__{high}", dim, "unipolar", high, high_text))
        else:
            rows.append((len(rows), f"{dim}__{high}", dim, "bipolar_high", high, high_text))
            rows.append((len(rows), f"{dim}__{low}", dim, "bipolar_low", low, low_text))
    # Through Arrow, the rows are Spark's own: a list of Python rows is a stage of Python workers in each query that reads it.
    schema = "anchor_index int, anchor_name string, dimension string, type string, label string, text string"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], names), schema)


def anchor_problems(anchors: DataFrame) -> DataFrame:
    """Contract check, must be empty: every axis complete, names and texts unique."""
    per = anchors.groupBy("dimension").agg(
        F.count_if(F.col("type") == "bipolar_high").alias("high"),
        F.count_if(F.col("type") == "bipolar_low").alias("low"),
        F.count_if(F.col("type") == "unipolar").alias("one"),
        F.count(F.lit(1)).alias("rows"), F.count_distinct("text").alias("texts"))
    good = ((F.col("high") == 1) & (F.col("low") == 1) & (F.col("one") == 0)) | (
        (F.col("high") == 0) & (F.col("low") == 0) & (F.col("one") == 1))
    return per.where(~good | (F.col("rows") != F.col("texts")) | ~F.col("dimension").isin(FEEL_DIMENSIONS))


def anchor_similarities(entities: DataFrame, anchors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Cosine of each entity with each anchor as an array in anchor order.

    The anchors are 23 rows by definition: they are fetched once, and entities are
    multiplied with them in Arrow batches without a shuffle.
    """
    rows = anchors.orderBy("anchor_index").select("anchor_vector").limit(N_ANCHORS + 1).collect()
    if len(rows) != N_ANCHORS:
        raise ValueError(f"expected {N_ANCHORS} anchors")
    ref = np.array([r["anchor_vector"] for r in rows], dtype=np.float64)
    ref /= np.maximum(np.linalg.norm(ref, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<double>")
    def cosines(v: pd.Series) -> pd.Series:
        m = np.array(v.tolist(), dtype=np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return pd.Series(list((m / np.where(length > 0, length, 1.0)) @ ref.T))

    # Nondeterministic to Spark, so that what explodes the result does not bring a filter that computes all of it a second
    # time, in a second worker of each task.
    return entities.withColumn("similarities", cosines.asNondeterministic()(F.col(vector)))


def feel_scores(df: DataFrame, defined: Column, sims: str = "similarities") -> DataFrame:
    """Two-ended axes score high minus low, one-ended ones the similarity; undefined rows 0."""
    out, i = [], 0
    for dim, _, low, _, _ in FEEL_AXES:
        score = F.col(sims)[i]
        if low is not None:
            score = score - F.col(sims)[i + 1]
        i += 1 if low is None else 2
        out.append(F.when(defined, score).otherwise(F.lit(0.0)).alias(dim))
    keep = [c for c in df.columns if c not in FEEL_DIMENSIONS and c != sims]
    return df.select(*keep, defined.alias("is_semantically_defined"), *out)


def scaler(df: DataFrame, dims: Sequence[str] = FEEL_DIMENSIONS) -> DataFrame:
    """One row of mean and population deviation per dimension; a zero deviation becomes 1."""
    cols = []
    for d in dims:
        sd = F.stddev_pop(d)
        cols += [F.avg(d).alias(f"{d}_mean"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"{d}_scale")]
    return df.agg(*cols)


def standardise(df: DataFrame, fitted_on: DataFrame, dims: Sequence[str] = FEEL_DIMENSIONS, prefix: str = "feel_z_") -> DataFrame:
    """Add z columns; ``fitted_on`` is the population the scale is taken from."""
    fit = scaler(fitted_on, dims)
    out = df.withColumn("_fit", fit.select(F.struct("*")).scalar())
    return out.select(
        *df.columns,
        *[((F.col(d) - F.col(f"_fit.{d}_mean")) / F.col(f"_fit.{d}_scale")).alias(prefix + d) for d in dims])


def to_long(df: DataFrame, ids: Sequence[str], dims: Sequence[str] = FEEL_DIMENSIONS, prefix: str = "") -> DataFrame:
    picked = df.select(*ids, *[F.col(prefix + d).alias(d) for d in dims])
    return picked.unpivot(list(ids), list(dims), "dimension", "value")


def describe_dimension(dim: str, z: Column) -> Column:
    """Readable direction of a standardised coordinate."""
    _, high, low, _, _ = AXIS[dim]
    words = (high, low) if low is not None else (f"high {high}", f"low {high}")
    return F.concat(F.when(z >= 0, words[0]).otherwise(words[1]), F.lit(" ("), signed_text(z), F.lit(")"))


def strongest_dimensions(dims: Sequence[str] = FEEL_DIMENSIONS, n: int = 5, prefix: str = "feel_z_") -> Column:
    """The ``n`` dimensions furthest from the mean, ties in axis order."""
    entries = [
        F.struct((-F.abs(F.col(prefix + d))).alias("order"), F.lit(i).alias("pos"), F.lit(d).alias("dimension"),
                 F.col(prefix + d).alias("z"))
        for i, d in enumerate(dims)]
    known = F.filter(F.array(*entries), lambda e: e["z"].isNotNull() & ~F.isnan(e["z"]))
    return F.transform(F.slice(F.array_sort(known), 1, n), lambda e: F.struct(
        e["dimension"].alias("dimension"), e["z"].alias("z")))


def shared_traits(left: str, right: str, dims: Sequence[str] = FEEL_DIMENSIONS, n: int = 5) -> Column:
    """Dimensions two items lean to the same side of, by the weaker of the two."""
    entries = []
    for i, d in enumerate(dims):
        a, b = F.col(f"{left}{d}"), F.col(f"{right}{d}")
        entries.append(F.struct(
            (-F.least(F.abs(a), F.abs(b))).alias("order"), F.lit(i).alias("pos"), F.lit(d).alias("dimension"),
            (a * b).alias("sign")))
    same = F.filter(F.array(*entries), lambda e: e["sign"] > 0)
    return F.transform(F.slice(F.array_sort(same), 1, n), lambda e: e["dimension"])


def feel_distance(left: str, right: str, dims: Sequence[str] = FEEL_DIMENSIONS) -> Column:
    """Euclidean distance over all dimensions, null when one is missing."""
    total = F.lit(0.0)
    for d in dims:
        gap = F.col(f"{left}{d}") - F.col(f"{right}{d}")
        total = total + gap * gap
    return F.sqrt(total)


def describe(df: DataFrame, groups: Sequence[str] = (), dims: Sequence[str] = FEEL_DIMENSIONS) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per (group, dimension)."""
    long = to_long(df, groups, dims)
    keys = [*groups, "dimension"]
    basic = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    parts = exact_percentiles(long, keys, "value", [0.25, 0.5, 0.75])
    return basic.join(parts.toDF(*keys, "q25", "median", "q75"), keys)


def domain_effects(df: DataFrame, dims: Sequence[str] = FEEL_DIMENSIONS, domain: str = "domain") -> DataFrame:
    """Eta squared of the domain on each dimension, and the range of domain means."""
    long = to_long(df, [domain], dims)
    per = long.groupBy("dimension", domain).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    # Total spread from the group spreads: within plus between.
    grand = per.groupBy("dimension").agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("v")).alias("within"), (F.max("m") - F.min("m")).alias("mean_range"))
    between = per.join(grand.select("dimension", "mean"), "dimension").groupBy("dimension").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"))
    both = grand.join(between, "dimension")
    spread = F.col("between") + F.col("within")
    return both.select(
        "dimension", F.when(spread > 0, F.col("between") / spread).otherwise(F.lit(0.0)).alias("eta_squared"),
        "mean_range", (F.col("mean_range") / F.nullif(F.sqrt(spread / F.col("total")), F.lit(0.0))).alias("standardised_range"))


def correlations(df: DataFrame, dims: Sequence[str] = FEEL_DIMENSIONS) -> DataFrame:
    """Pearson correlation of every pair of dimensions, in a single pass."""
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], one.columns, "pair", "r")
    names = F.split("pair", r"\|")
    return long.select(names[0].alias("left_dim"), names[1].alias("right_dim"), "r")


def extremes(df: DataFrame, ids: Sequence[str], n: int, scope: str = "domain", dims: Sequence[str] = FEEL_DIMENSIONS) -> DataFrame:
    """The ``n`` lowest and highest items per dimension, overall and inside each scope."""
    long = to_long(df, [*ids, scope] if scope not in ids else ids, dims).where("value IS NOT NULL")
    both = long.withColumn("scope", F.explode(F.array(F.col(scope), F.lit("all_domains"))))
    keys, tie = ["scope", "dimension"], F.col(ids[0])
    low = top_per_group(both, keys, [F.col("value"), tie], n).withColumn("side", F.lit("low"))
    high = top_per_group(both, keys, [F.col("value").desc(), tie], n).withColumn("side", F.lit("high"))
    return low.unionByName(high)
