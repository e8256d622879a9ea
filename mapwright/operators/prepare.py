"""Entity and review preparation, summaries and data-quality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.functions import values as V
from mapwright.operators.histogram import attach_ranks, exact_percentiles


def resolve_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Rename the first available candidate of each canonical column; error if none."""
    for name, candidates in aliases.items():
        found = next((c for c in candidates if c in df.columns), None)
        if found is None:
            raise ValueError(f"none of {list(candidates)} is a column")
        df = df.withColumnRenamed(found, name)
    return df


def rating_stats(ratings: DataFrame, key: str = "movie_id") -> DataFrame:
    return ratings.groupBy(key).agg(
        F.avg("rating").alias("avg_rating"), F.count("rating").alias("rating_count"),
        F.stddev_samp("rating").alias("rating_std"))


def weighted_rating(stats: DataFrame) -> DataFrame:
    """Pull small samples towards the mean rating; weight is the upper quartile of votes."""
    prior = stats.agg(F.avg("avg_rating")).scalar()
    weight = exact_percentiles(stats, [], "rating_count", [0.75]).scalar()
    return stats.withColumn(
        "weighted_rating",
        V.bayes_rating(F.col("avg_rating"), F.col("rating_count"), prior, weight))


def joined_text(df: DataFrame, key: str, text: str, order: Sequence[str], name: str, sep: str = " ") -> DataFrame:
    """All non-null texts of a key in the given order, and how many there are."""
    rows = F.collect_list(F.struct(*order, text))
    return df.where(F.col(text).isNotNull()).groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(rows), lambda r: r[text]), sep).alias(name),
        F.count(text).alias(f"{name}_count"))


def text_parts(df: DataFrame, key: str, text: str, position: str, order: Sequence[str], rows: int = 10000, sep: str = " ") -> DataFrame:
    """The texts of a key as numbered parts of about ``rows`` texts each, in order.

    For keys with very many texts: places come from the histogram over the numeric
    ``position``, so no task ever holds more than one part. The parts in order, joined by
    ``sep``, are the text :func:`joined_text` gives.
    """
    known = df.where(F.col(text).isNotNull())
    placed = attach_ranks(known, [key], position).withColumn("part", F.floor(F.col("below") / rows))
    texts = F.collect_list(F.struct(*order, text))
    return placed.groupBy(key, "part").agg(
        F.array_join(F.transform(F.sort_array(texts), lambda r: r[text]), sep).alias("text"), F.count(text).alias("texts"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``. Each task keeps one row per key
    before the shuffle, so a key with many copies stays cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prepare_reviews(
    raw: DataFrame, order: Sequence[str], rating_max: float = 10.0, entity: str = "entity_id"
) -> DataFrame:
    """Valid reviews: entity and id present, first copy of an id, text not blank.

    The copy is chosen before blank texts go, so an id whose first copy is blank is gone.
    """
    valid = raw.where(V.blank_to_null(F.col(entity).cast("string")).isNotNull())
    valid = valid.withColumn("review_id", F.trim("review_id")).where("review_id <> ''")
    first = keep_first(valid, ["review_id"], order)
    text = T.collapse_spaces(F.col("review_text"))
    return (
        first.withColumn("review_text", text).where("review_text <> ''")
        .withColumn("rating", V.within(F.col("rating"), 1.0, rating_max))
        .withColumn("spoiler_tag", V.flag_from_number(F.col("spoiler_tag")))
        .withColumn("helpful_votes", V.helpful_votes(F.col("helpful")))
        .withColumn("review_char_count", F.length("review_text"))
        .withColumn("review_word_count", T.word_count(F.col("review_text")))
    )


def rejection_counts(raw: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Rows lost per rule when reviews are prepared.

    Identifiers are counted per value first, so copies of one id meet as counts only.
    """
    has_entity = V.blank_to_null(F.col(entity).cast("string")).isNotNull()
    rid = V.blank_to_null(F.col("review_id"))
    flags = raw.select(has_entity.alias("has_entity"), rid.alias("rid"))
    per_id = flags.where("has_entity AND rid IS NOT NULL").groupBy("rid").count()
    extra = per_id.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).scalar()
    return flags.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(~F.col("has_entity")).alias("missing_entity"),
        F.count_if(F.col("has_entity") & F.col("rid").isNull()).alias("missing_review_id"),
    ).withColumn("duplicates", extra)


def movie_review_summary(reviews: DataFrame, entity: str = "entity_id") -> DataFrame:
    ratio = F.col("helpful_votes.ratio")
    return reviews.groupBy(entity).agg(
        F.count(F.lit(1)).alias("review_count"), F.count("rating").alias("review_rating_count"),
        F.avg("rating").alias("review_rating_mean"), F.stddev_samp("rating").alias("review_rating_std"),
        F.sum("spoiler_tag").alias("spoiler_review_count"), F.avg("spoiler_tag").alias("spoiler_ratio"),
        F.avg(ratio).alias("avg_helpful_ratio"), F.avg("review_char_count").alias("avg_review_char_count"),
        F.avg("review_word_count").alias("avg_review_word_count"))


# Kinds of entity an artist review was written for.
ENTITY_TYPES = {"artist": "direct_artist_review_count", "release": "release_review_count",
                "release_group": "release_group_review_count"}


def music_review_summary(reviews: DataFrame, entity: str = "entity_id") -> DataFrame:
    sources = [F.count_if(F.col("entity_type") == k).alias(v) for k, v in ENTITY_TYPES.items()]
    return reviews.groupBy(entity).agg(
        F.count(F.lit(1)).alias("review_count"), F.count("rating").alias("review_rating_count"),
        F.avg("rating").alias("review_rating_mean"), F.avg("review_word_count").alias("avg_review_word_count"),
        *sources)


def restaurant_review_summary(reviews: DataFrame, ids: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One row per known entity, zero counts for those without a review."""
    stats = reviews.groupBy(entity).agg(
        F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("review_rating_mean"),
        F.avg("useful").alias("avg_useful"), F.avg("funny").alias("avg_funny"), F.avg("cool").alias("avg_cool"))
    return ids.select(entity).distinct().join(stats, entity, "left").na.fill(0, ["review_count"])


def threshold_counts(counts: DataFrame, count: str, thresholds: Sequence[int]) -> DataFrame:
    """How many entities reach each number of reviews, in one pass."""
    one = counts.agg(*[F.count_if(F.col(count) >= n).alias(str(n)) for n in thresholds])
    return one.unpivot([], [str(n) for n in thresholds], "threshold", "entities").withColumn(
        "threshold", F.col("threshold").cast("int"))


def source_mix(reviews: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities whose reviews are direct only, release only, or both."""
    per = reviews.groupBy(entity).agg(
        F.bool_or(F.col("entity_type") == "artist").alias("direct"),
        F.bool_or(F.col("entity_type") != "artist").alias("release"))
    mix = F.when(F.col("direct") & F.col("release"), "mixed").when(F.col("direct"), "direct_only")
    return per.groupBy(mix.otherwise("release_only").alias("mix")).agg(F.count(F.lit(1)).alias("entities"))


def conflicting_ids(reviews: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Review ids that point at more than one entity."""
    pairs = reviews.groupBy("review_id", entity).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows")).where("entities > 1")


def quality_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows, nulls, distinct values and surplus copies of one column."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(column).isNotNull()
    return per.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(known).alias("distinct_values"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("surplus"))


def coverage(reviews: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, on one side only, and reviews whose key is unknown."""
    left = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    right = ids.select(key).distinct().withColumn("known", F.lit(True))
    both = left.join(right, key, "full_outer")
    return both.agg(
        F.count_if(F.col("n").isNotNull() & F.col("known").isNotNull()).alias("matched"),
        F.count_if(F.col("known").isNull()).alias("only_reviews"),
        F.count_if(F.col("n").isNull()).alias("only_entities"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphan_reviews"))


def filter_artists(df: DataFrame, min_listeners: int = 1000) -> DataFrame:
    return df.where((F.col("listeners") >= min_listeners) & ~F.col("ambiguous"))


def filter_restaurants(df: DataFrame, min_reviews: int = 20) -> DataFrame:
    return df.where(F.lower("categories").contains("restaurants") & (F.col("review_count") >= min_reviews))


def union_domains(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack domains with differing columns under a global id ``domain:source_id``; an id that repeats is an error."""
    out = None
    for domain, df in parts.items():
        df = df.withColumn("domain", F.lit(domain)).withColumn(
            "source_id", V.id_key(F.col("source_id"))).withColumn(
            "id", V.global_id(F.col("domain"), F.col("source_id")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return unique(out, "id")


def unique(df: DataFrame, key: str) -> DataFrame:
    """The rows themselves; a key that repeats raises inside the task that meets it."""
    copies = F.count(F.lit(1)).over(Window.partitionBy(key))
    guard = F.when(copies > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_once", guard).where("_once").drop("_once")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Contract check: must be empty."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def to_metric_rows(one_row: DataFrame, prefix: str = "") -> DataFrame:
    """Turn one wide row into (metric, value) rows."""
    cols = one_row.columns
    wide = one_row.select(*[F.col(c).cast("double").alias(prefix + c) for c in cols])
    return wide.unpivot([], [prefix + c for c in cols], "metric", "value")
