"""Item details: feel profile, where the meaning came from, and a sample of reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.functions.constants import FEEL_DIMENSIONS
from mapwright.functions.values import finite, sample_score
from mapwright.operators.ranking import top_per_group

SHOWN_REVIEWS = 5


def item_profiles(items: DataFrame, z: DataFrame, modalities: DataFrame, counts: DataFrame, dims: Sequence[str] = FEEL_DIMENSIONS) -> DataFrame:
    """Profile of every item: z values to five digits, sources, and review counts.

    ``z``: id and feel_z columns; ``modalities``: id, flags and source; ``counts``: id and
    available_count.
    """
    wide = items.join(z, "id", "left").join(modalities, "id", "left").join(counts, "id", "left")
    available = F.coalesce("available_count", F.lit(0).cast("bigint"))
    return wide.select(
        "id", "domain", "source_id", "title",
        F.struct(*[F.round(finite(F.col(f"feel_z_{d}")), 5).alias(d) for d in dims]).alias("feel"),
        F.coalesce("has_base_semantics", F.lit(False)).alias("has_base_semantics"),
        F.coalesce("has_review_semantics", F.lit(False)).alias("has_review_semantics"),
        F.coalesce("semantic_source", F.lit("none")).alias("semantic_source"),
        available.alias("reviews_available"),
        F.coalesce("reviews_used_for_embedding", F.lit(0)).alias("reviews_used"),
        F.least(available, F.lit(SHOWN_REVIEWS)).alias("reviews_sampled"))


def review_samples(reviews: DataFrame, entity: str, fields: Sequence[str], n: int = SHOWN_REVIEWS, seed: int = 42) -> DataFrame:
    """Per entity: how many reviews there are and the ``n`` with the smallest hash.

    Rows are cut to ``n`` inside each task before they meet, so no list ever grows past it.
    """
    counts = reviews.groupBy(entity).agg(F.count(F.lit(1)).alias("available_count"))
    scored = reviews.withColumn("_s", sample_score(seed, F.col(entity), F.col("review_id")))
    top = top_per_group(scored, [entity], [F.col("_s"), F.col("review_id")], n, "_r")
    lists = top.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("_r", F.struct(*fields).alias("review")))).alias("l"))
    return counts.join(lists, entity).select(
        entity, "available_count", F.size("l").cast("bigint").alias("sampled_count"), F.transform("l", lambda e: e["review"]).alias("reviews"))
