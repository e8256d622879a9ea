"""Aligning and fusing the vectors of two modalities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.functions import vectors as VX
from mapwright.functions.constants import SOURCE_LABELS
from mapwright.functions.values import global_id

# Rows put side by side at once.
FUSED_ROWS = 2048


def align(base: DataFrame, reviews: DataFrame, size: int) -> DataFrame:
    """Give every entity its review vector; zeros, count 0 and a flag where there is none."""
    right = reviews.select(
        "domain", "entity_id", F.col("embedding").alias("review_embedding"), "review_count", F.lit(True).alias("has_review"))
    joined = base.join(right, ["domain", "entity_id"], "left")
    return joined.withColumn(
        "review_embedding", F.coalesce(VX.doubles(F.col("review_embedding")), VX.zeros(size))
    ).na.fill({"review_count": 0, "has_review": False})


def mean_pool(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean of the vectors of each key, length one, and how many went in.

    Partial sums are taken inside each task, so a key with most of the rows sends one
    vector per task.
    """
    pooled = df.withColumn("_v", array_to_vector(VX.doubles(F.col(vector)))).groupBy(key).agg(
        Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("review_count"))
    return pooled.select(key, VX.unit(vector_to_array("_m")).alias("embedding"), "review_count")


def concat_fusion(a: Column, b: Column, share: float) -> Column:
    """``[sqrt(1 - share) * a ; sqrt(share) * b]`` with length one."""
    return VX.unit(F.concat(VX.scale(a, (1 - share) ** 0.5), VX.scale(b, share**0.5)))


def concat_fusion_rows(df: DataFrame, key: str, a: str, b: str, size: int, share: float) -> DataFrame:
    """``concat_fusion`` of two columns as ``embedding``, a batch at a time; a missing ``b`` is ``size`` zeros."""
    left, right = (1 - share) ** 0.5, share**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FUSED_ROWS):
                part = batch.slice(start, FUSED_ROWS)
                first = VX.rows_of(part.column(1), VX.width_of(part.column(1)))
                known = part.column(2).is_valid().to_numpy(zero_copy_only=False)
                out = np.zeros((len(first), first.shape[1] + size))
                out[:, : first.shape[1]] = first * left
                out[known, first.shape[1] :] = VX.rows_of(part.column(2).drop_null(), size) * right
                length = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
                np.divide(out, length, out=out, where=length > 0)
                ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[key, "embedding"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<double>"
    return df.select(key, VX.doubles(F.col(a)).alias("a"), VX.doubles(F.col(b)).alias("b")).mapInArrow(run, schema)


def additive_fusion(a: Column, b: Column, share: float) -> Column:
    """Weighted sum where both are known, the known one otherwise, with length one.

    Vectors of unequal size, and known vectors that cancel each other out, are errors.
    """
    total = F.zip_with(VX.doubles(a), VX.doubles(b), lambda x, y: x * (1 - share) + y * share)
    unequal = F.size(a) != F.size(b)
    total = F.when(unequal, F.raise_error(F.lit("the vectors have unequal sizes")).cast("array<double>")).otherwise(total)
    total = F.when(VX.norm(total) == 0, F.raise_error(F.lit("the vectors cancel each other out")).cast("array<double>")).otherwise(total)
    both = VX.norm(a).__gt__(0) & VX.norm(b).__gt__(0)
    return VX.unit(F.when(both, total).when(VX.norm(a) > 0, VX.doubles(a)).otherwise(VX.doubles(b)))


def source_code(has_base: Column, has_reviews: Column) -> Column:
    return (has_base.cast("int") + has_reviews.cast("int") * 2).cast("tinyint")


def source_label(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SOURCE_LABELS]), code.cast("int") + 1)


def fuse_modalities(base: DataFrame, reviews: DataFrame, size: int, share: float = 0.5) -> DataFrame:
    """Fused vector, flags and source code of every entity known in either modality."""
    b = base.select("domain", "entity_id", VX.doubles(F.col("embedding")).alias("base_embedding"))
    r = reviews.select("domain", "entity_id", VX.doubles(F.col("embedding")).alias("review_embedding"), "review_count")
    both = b.join(r, ["domain", "entity_id"], "full_outer")
    filled = both.select(
        "domain", "entity_id", global_id(F.col("domain"), F.col("entity_id")).alias("id"),
        F.coalesce("base_embedding", VX.zeros(size)).alias("base_embedding"),
        F.coalesce("review_embedding", VX.zeros(size)).alias("review_embedding"),
        F.coalesce("review_count", F.lit(0)).alias("reviews_used_for_embedding"))
    flagged = filled.withColumn("has_base_semantics", VX.norm(F.col("base_embedding")) > 0).withColumn(
        "has_review_semantics", VX.norm(F.col("review_embedding")) > 0)
    fused = additive_fusion(F.col("base_embedding"), F.col("review_embedding"), share)
    return flagged.select(
        "*", fused.alias("embedding"),
        source_code(F.col("has_base_semantics"), F.col("has_review_semantics")).alias("source_code"),
    ).withColumn("semantic_source", source_label(F.col("source_code"))).drop("base_embedding", "review_embedding")


def modality_coverage(fused: DataFrame) -> DataFrame:
    """Entities and percent per domain and source, zero cells kept."""
    counts = fused.groupBy("domain").pivot("semantic_source", SOURCE_LABELS).count().na.fill(0)
    total = sum((F.col(f"`{s}`") for s in SOURCE_LABELS), F.lit(0))
    long = counts.withColumn("total", total).unpivot(["domain", "total"], [f"`{s}`" for s in SOURCE_LABELS], "source", "entities")
    return long.select(
        "domain", F.regexp_replace("source", "`", "").alias("source"), "entities",
        (F.col("entities") / F.col("total") * 100).alias("percent"))
