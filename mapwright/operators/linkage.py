"""Exact linkage of reviews to catalogue titles, without fuzzy comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.functions.values import blank_to_null


def title_index(catalogue: DataFrame, key: str = "movie_id", title: str = "title") -> DataFrame:
    """Candidates per (title key, year): how many, and the smallest id."""
    keyed = catalogue.select(
        F.col(key).alias("candidate"), T.match_key(T.strip_review_title(F.col(title))).alias("match_key"),
        T.year_in_title(F.col(title)).alias("year")).where("match_key <> ''")
    return keyed.groupBy("match_key", "year").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("candidate").alias("candidate"))


def link_reviews(reviews: DataFrame, catalogue: DataFrame, movie: str = "movie", key: str = "movie_id") -> DataFrame:
    """Attach candidate, status, method and score to every review.

    Reviews collapse to distinct titles before the joins: a title with a large part of
    all reviews is resolved once, and the result comes back on the raw title.
    """
    titles = reviews.select(movie).distinct()
    keyed = titles.select(
        movie, blank_to_null(F.col(movie)).isNull().alias("no_title"),
        T.match_key(T.strip_review_title(F.col(movie))).alias("match_key"),
        T.first_year(F.col(movie)).alias("year"))
    index = title_index(catalogue, key)
    by_year = index.where("year IS NOT NULL").select(
        "match_key", "year", F.col("candidates").alias("n_year"), F.col("candidate").alias("c_year"))
    by_title = index.groupBy("match_key").agg(
        F.sum("candidates").alias("n_title"), F.min("candidate").alias("c_title"))
    joined = keyed.join(by_year, ["match_key", "year"], "left").join(by_title, "match_key", "left")
    n_year, n_title = F.coalesce("n_year", F.lit(0)), F.coalesce("n_title", F.lit(0))
    has_year = F.col("year").isNotNull()

    def outcome(status, method, score, candidate=None):
        return F.struct(
            F.lit(status).alias("match_status"), F.lit(method).alias("match_method"),
            F.lit(score).alias("match_score"),
            (F.col(candidate) if candidate else F.lit(None)).cast("bigint").alias(key))

    # Status, method and score names of each outcome.
    result = (
        F.when(F.col("no_title"), outcome("invalid", "missing_title", 0.0))
        .when(F.col("match_key") == "", outcome("invalid", "empty_normalized_title", 0.0))
        .when(has_year & (n_year == 1), outcome("accepted", "exact_title_year", 1.0, "c_year"))
        .when(has_year & (n_year > 1), outcome("ambiguous", "exact_title_year_multiple_candidates", 1.0))
        .when(has_year & (n_title > 0), outcome("unmatched", "title_found_but_year_mismatch", 0.0))
        .when(has_year, outcome("unmatched", "no_exact_title_year_match", 0.0))
        .when(n_title == 1, outcome("accepted", "unique_exact_title_without_year", 0.99, "c_title"))
        .when(n_title > 1, outcome("ambiguous", "exact_title_multiple_candidates_without_year", 0.0))
        .otherwise(outcome("unmatched", "no_exact_title_match", 0.0))
    )
    resolved = joined.select(movie, result.alias("m")).select(movie, "m.*")
    return reviews.join(resolved, reviews[movie].eqNullSafe(resolved[movie]), "left").drop(resolved[movie])


def match_report(linked: DataFrame) -> DataFrame:
    total = linked.agg(F.count(F.lit(1))).scalar()
    return linked.groupBy("match_status").agg(F.count(F.lit(1)).alias("reviews")).withColumn(
        "rate", F.col("reviews") / total)
