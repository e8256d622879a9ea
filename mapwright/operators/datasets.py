"""Joins that put a domain's entity table together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.operators import prepare as P


def movies_with_all(movies: DataFrame, ratings: DataFrame, tags: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every movie with its rating figures and tag text; missing counts 0, missing text blank."""
    stats = P.rating_stats(ratings)
    text = P.joined_text(tags, "movie_id", "tag", order, "tags_text").withColumnRenamed("tags_text_count", "tag_count")
    return movies.join(stats, "movie_id", "left").join(text, "movie_id", "left").na.fill(
        {"rating_count": 0, "tag_count": 0, "tags_text": ""})


def movie_texts(movies: DataFrame, tags: DataFrame, order: Sequence[str]) -> DataFrame:
    """Descriptive text of every movie and which parts it came from."""
    text = P.joined_text(tags, "movie_id", "tag", order, "tags_text")
    joined = movies.join(text, "movie_id", "left")
    whole = F.concat_ws(" ", F.regexp_replace(T.text_or_empty(F.col("genres")), r"\|", " "), T.text_or_empty(F.col("tags_text")))
    return joined.select(
        "movie_id", T.collapse_spaces(whole).alias("text"), F.col("genres").isNotNull().alias("has_genres"),
        F.col("tags_text").isNotNull().alias("has_tags"))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails when a key repeats on the joined side.

    The check rides along with the join: copies of a key are counted while the right
    side is grouped, and a count above one raises inside the task.
    """
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest])
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit("join key repeats"))).otherwise(F.lit(True))
    return left.join(once.where(guard).drop("_n"), list(keys))


def matched_population(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities of two maps and which of them hold each."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    return left.join(right, list(keys), "full_outer").select(
        *keys, F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"))


def quality_report(raw: DataFrame, prepared: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Review data quality as (metric, value) rows."""
    entities = prepared.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    basics = prepared.agg(
        F.count(F.lit(1)).alias("rows"), F.count("rating").alias("rated"), F.sum("useful").alias("useful"),
        F.max("review_char_count").alias("longest"))
    reach = entities.agg(
        F.count(F.lit(1)).alias("entities"),
        *[F.count_if(F.col("n") >= k).alias(f"reviews_at_least_{k}") for k in thresholds])
    conflicts = P.conflicting_ids(raw).agg(F.count(F.lit(1)).alias("conflicting_ids"))
    out = P.to_metric_rows(basics)
    for part in (reach, conflicts):
        out = out.unionByName(P.to_metric_rows(part))
    return out
