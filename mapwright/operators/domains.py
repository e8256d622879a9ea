"""Music and restaurant forms of prepared reviews, entity texts and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.functions import values as V
from mapwright.operators import prepare as P

# Texts that stand for a missing date.
NO_DATE = ["", "<NA>", "nan", "None"]


def _cleaned(first: DataFrame, text: str, date: Column, source: str) -> DataFrame:
    """Reviews with a text: text without surplus spaces, rating of 1 to 5 or null, lengths and source."""
    return (
        first.withColumn("review_text", T.collapse_spaces(F.col(text))).where("review_text <> ''")
        .withColumn("rating", V.within(F.col("rating"), 1.0, 5.0)).withColumn("review_date", date)
        .withColumn("review_char_count", F.length("review_text"))
        .withColumn("review_word_count", T.word_count(F.col("review_text")))
        .withColumn("source", F.lit(source)))


def _filled(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys hold more than spaces, the keys trimmed."""
    for key in keys:
        df = df.withColumn(key, V.blank_to_null(F.col(key).cast("string"))).where(F.col(key).isNotNull())
    return df


def music_reviews(raw: DataFrame, order: Sequence[str], artist: str = "artist_mbid", text: str = "text") -> DataFrame:
    """One row per matched review: artist and id present, first copy of an id, text not blank.

    A review id that belongs to several artists is an error, raised by the task that meets it. First copy and check come
    from one aggregate, so an id with many copies stays cheap.
    """
    valid = _filled(raw.where(V.tri_state(F.col("matched"))), artist, "review_id")
    rest = [c for c in valid.columns if c != "review_id"]
    one = valid.groupBy("review_id").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.min(artist).alias("a"), F.max(artist).alias("b"))
    several = F.raise_error(F.concat(F.lit("review id of several artists: "), F.col("review_id"))).cast("boolean")
    first = one.where(F.when(F.col("a") != F.col("b"), several).otherwise(F.lit(True))).select("review_id", "r.*")
    date = F.trim("created")
    date = F.when(~date.isin(NO_DATE), date)
    return _cleaned(first, text, date, "CritiqueBrainz").withColumn("language", F.lower(F.trim("language"))).withColumn(
        "original_entity_type", F.lower(F.trim("original_entity_type")))


def restaurant_reviews(raw: DataFrame, ids: DataFrame, order: Sequence[str], business: str = "business_id", text: str = "text") -> DataFrame:
    """One row per review of a known restaurant: id present, first copy of an id, text not blank, votes 0 if missing."""
    known = _filled(raw, business).join(ids.select(business).distinct(), business, "left_semi")
    first = P.keep_first(_filled(known, "review_id"), ["review_id"], order)
    cleaned = _cleaned(first, text, V.blank_to_null(F.col("date").cast("string")), "Yelp")
    return cleaned.withColumns({c: F.coalesce(V.to_int(F.col(c)), F.lit(0)) for c in ("useful", "funny", "cool")})


def _checked(entities: DataFrame, key: str) -> DataFrame:
    """The rows with a trimmed key; a blank or repeated key is an error."""
    name = F.trim(F.col(key).cast("string"))
    blank = F.raise_error(F.lit(f"{key} is blank")).cast("string")
    return P.unique(entities.withColumn(key, F.when(F.coalesce(name, F.lit("")) == "", blank).otherwise(name)), key)


def artist_texts(artists: DataFrame, min_listeners: int = 1000) -> DataFrame:
    """Text of the tags of every artist that passes the filter, and whether there is any."""
    text = F.replace(F.coalesce("tags_lastfm", F.lit("")), F.lit(";"), F.lit(" "))
    chosen = _checked(P.filter_artists(artists, min_listeners), "mbid")
    return chosen.select("mbid", text.alias("tags_text"), (F.trim(text) != "").alias("has_text"))


def restaurant_texts(business: DataFrame, tips: DataFrame, order: Sequence[str], min_reviews: int = 20) -> DataFrame:
    """Categories and tips of every restaurant that passes the filter as one text, and whether there is any."""
    chosen = _checked(P.filter_restaurants(business, min_reviews), "business_id")
    joined = chosen.join(P.joined_text(tips, "business_id", "text", order, "tip_text"), "business_id", "left")
    text = F.concat(F.coalesce("categories", F.lit("")), F.lit(" "), F.coalesce("tip_text", F.lit("")))
    return joined.select("business_id", text.alias("tags_text"), (F.trim(text) != "").alias("has_text"))


def _all_rows(parts: Sequence[DataFrame]) -> DataFrame:
    out = P.to_metric_rows(parts[0])
    for part in parts[1:]:
        out = out.unionByName(P.to_metric_rows(part))
    return out


def music_report(raw: DataFrame, artists: DataFrame, thresholds: Sequence[int], artist: str = "artist_mbid", text: str = "text") -> DataFrame:
    """Data quality of music reviews as (metric, value): match status, ids, artists against the data set, texts, ratings,
    reviews an artist, and whether an artist's usable reviews are its own, of its releases, or both."""
    usable = F.coalesce(T.collapse_spaces(F.col(text)) != "", F.lit(False))
    r = raw.select(
        V.blank_to_null(F.col("review_id")).alias("rid"), V.blank_to_null(F.col(artist)).alias("who"),
        V.tri_state(F.col("matched")).alias("matched"), usable.alias("usable"), V.to_double(F.col("rating")).alias("rating"),
        (F.lower(F.trim("original_entity_type")) == "artist").alias("direct"))
    count = lambda c, name: F.count_if(c).alias(name)
    rows = r.agg(
        F.count(F.lit(1)).alias("rows"), count(F.col("matched"), "matched"), count(~F.col("matched"), "unmatched"),
        count(F.col("matched").isNull(), "unknown_match"), count(F.col("rid").isNull(), "missing_review_ids"),
        count(F.col("who").isNull(), "missing_artists"), count(F.col("usable"), "usable_texts"),
        count(~F.col("usable"), "empty_texts"), count(F.col("rating").isNotNull(), "rated"), count(F.col("rating").isNull(), "unrated"))
    per_id = r.where("rid is not null").groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("who").alias("a"), F.max("who").alias("b"))
    ids = per_id.agg(
        F.count(F.lit(1)).alias("unique_review_ids"), count(F.col("n") > 1, "duplicate_review_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), count(F.col("a") != F.col("b"), "conflicting_ids"))
    per_artist = r.where("who is not null").groupBy("who").agg(
        count(F.col("usable"), "n"), count(F.col("usable") & F.col("direct"), "own"))
    known = artists.select(V.blank_to_null(F.col("mbid")).alias("who")).where("who is not null").distinct().withColumn("known", F.lit(True))
    both = per_artist.join(known, "who", "full_outer")
    reviewed, listed = F.col("n").isNotNull(), F.col("known").isNotNull()
    met = both.agg(
        count(listed, "dataset_artists"), count(reviewed, "reviewed_artists"), count(reviewed & listed, "known_artists"),
        count(reviewed & ~listed, "unknown_artists"), (F.count_if(reviewed & listed) / F.nullif(F.count_if(listed), F.lit(0))).alias("artist_coverage"),
        *[count(F.col("n") >= k, f"artists_at_least_{k}") for k in thresholds],
        count((F.col("n") > 0) & (F.col("own") == F.col("n")), "direct_only"),
        count((F.col("n") > 0) & (F.col("own") == 0), "release_only"),
        count((F.col("own") > 0) & (F.col("own") < F.col("n")), "mixed"))
    return _all_rows([rows, ids, met])


def restaurant_report(business: DataFrame, reviews: DataFrame, tips: DataFrame, ids: DataFrame) -> DataFrame:
    """Data quality of restaurants as (metric, value): raw table, the map's ids in it, and their reviews and tips."""
    name = lambda df: df.withColumn("id", V.blank_to_null(F.col("business_id").cast("string")))
    tokens = F.transform(F.split(F.lower("categories"), ","), lambda s: F.trim(s))
    ids = name(ids).where("id is not null").select("id").distinct().withColumn("known", F.lit(True))
    table = name(business).agg(
        F.count(F.lit(1)).alias("businesses"), F.count_if(F.col("categories") != "").alias("with_categories"),
        F.count_if(F.array_contains(tokens, "restaurants")).alias("category_restaurants"))
    n = F.count(F.lit(1))
    sides = [name(business).groupBy("id").agg(n.alias("in_table")), name(reviews).groupBy("id").agg(n.alias("reviews")),
             name(tips).groupBy("id").agg(n.alias("tips"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"))]
    per = ids
    for side in sides:  # null ids meet nothing and still count in the totals
        per = per.join(side, "id", "full_outer")
    known, total = F.col("known").isNotNull(), lambda c: F.coalesce(F.sum(c), F.lit(0))
    mine = lambda c: known & F.col(c).isNotNull()
    met = per.agg(
        F.count_if(F.col("in_table").isNotNull() & F.col("id").isNotNull()).alias("unique_ids"), F.count_if(known).alias("map_ids"),
        F.count_if(mine("in_table")).alias("found"), F.count_if(known & F.col("in_table").isNull()).alias("missing"),
        total(F.col("reviews")).alias("reviews"), total(F.when(known, F.col("reviews"))).alias("map_reviews"),
        F.count_if(mine("reviews")).alias("with_reviews"),
        (F.count_if(mine("reviews")) / F.nullif(F.count_if(known), F.lit(0))).alias("review_coverage"),
        total(F.col("tips")).alias("tips"), total(F.when(known, F.col("tips"))).alias("map_tips"),
        F.count_if(mine("tips")).alias("with_tips"), total(F.when(known, F.col("empty"))).alias("empty_map_tips"))
    return _all_rows([table, met])
