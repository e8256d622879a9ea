"""Checked queries: music and restaurant forms of reviews, texts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.operators import domains as D
from mapwright.operators import prepare as P
from mapwright.plans.q_prepare import TAG_ORDER
from mapwright.plans.registry import query, r6

TEXT = r"trim(regexp_replace(review_text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))"
RATING = "CASE WHEN CAST(rating AS DOUBLE) BETWEEN 1 AND 5 THEN CAST(rating AS DOUBLE) END AS rating"
LENGTHS = f"CAST(length({TEXT}) AS INTEGER) AS review_char_count, CAST(len(string_split({TEXT}, ' ')) AS INTEGER) AS review_word_count, md5({TEXT}) AS text_hash"


def music_raw(t):
    """The reviews under ids of their own for each artist, with dates of which some are blank or no date."""
    date = F.when(F.col("n_chars") % 4 == 0, " ").when(F.col("n_chars") % 4 == 1, "nan").otherwise(F.concat(F.lit(" 2019-0"), F.col("n_chars") % 4, F.lit("-01 ")))
    return t.raw_reviews.withColumns({"review_id": F.concat("entity_id", F.lit("-"), "review_id"), "created": date}).withColumnsRenamed(
        {"entity_id": "artist_mbid", "entity_type": "original_entity_type", "review_text": "text"})


@query("c07_music_reviews", f"""
    SELECT ord, entity_id || '-' || review_id AS review_id, entity_id AS artist_mbid, {RATING}, lower(trim(language)) AS language, entity_type AS original_entity_type,
      CASE WHEN n_chars % 4 > 1 THEN concat('2019-0', n_chars % 4, '-01') END AS review_date, {LENGTHS}, 'CritiqueBrainz' AS source
    FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, review_id ORDER BY ord) AS rn FROM raw_reviews WHERE matched = 'True')
    WHERE rn = 1 AND {TEXT} <> ''""")
def c07_music(t):
    return D.music_reviews(music_raw(t), ["ord"]).select(
        "ord", "review_id", "artist_mbid", "rating", "language", "original_entity_type", "review_date", "review_char_count",
        "review_word_count", F.md5("review_text").alias("text_hash"), "source")


@query("c07_restaurant_reviews", f"""
    SELECT ord, review_id, entity_id AS business_id, {RATING}, CASE WHEN language <> 'en' THEN language END AS review_date,
      useful, coalesce(CASE WHEN funny > 0 THEN funny END, 0) AS funny, cool, {LENGTHS}, 'Yelp' AS source
    FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord) AS rn FROM raw_reviews
      WHERE entity_id IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0))
    WHERE rn = 1 AND {TEXT} <> ''""")
def c07_restaurants(t):
    ids = t.documents.groupBy(F.col("source").alias("business_id")).agg(F.min("doc_id").alias("d")).where("d % 2 = 0")
    raw = t.raw_reviews.withColumnsRenamed({"entity_id": "business_id", "review_text": "text"}).withColumns(
        {"date": F.when(F.col("language") != "en", F.concat(F.lit(" "), "language")).otherwise(" "), "funny": F.when(F.col("funny") > 0, F.col("funny"))})
    return D.restaurant_reviews(raw, ids, ["ord"]).select(
        "ord", "review_id", "business_id", "rating", "review_date", "useful", "funny", "cool", "review_char_count",
        "review_word_count", F.md5("review_text").alias("text_hash"), "source")


@query("c08_artist_texts", """
    SELECT mbid, replace(coalesce(tags_lastfm, ''), ';', ' ') AS tags_text, tags_lastfm IS NOT NULL AS has_text FROM artists WHERE listeners >= 1000 AND NOT ambiguous""")
def c08_artists(t):
    return D.artist_texts(t.artists)


@query("c08_restaurant_texts", """
    WITH g AS (SELECT business_id, string_agg(text, ' ' ORDER BY ord, line, price) AS tx FROM tips GROUP BY 1)
    SELECT business_id, md5(concat(categories, ' ', coalesce(tx, ''))) AS text_hash, true AS has_text
    FROM business LEFT JOIN g USING (business_id) WHERE contains(lower(categories), 'restaurants') AND review_count >= 20""")
def c08_restaurants(t):
    return D.restaurant_texts(t.business, t.tips, TAG_ORDER).select("business_id", F.md5("tags_text").alias("text_hash"), "has_text")


def metrics_sql(*parts):
    """One row per (name, value) of each part, a pair of the pairs and what they are taken from."""
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, R6({value}) AS value FROM {source}" for pairs, source in parts for name, value in pairs)


THRESHOLDS = [1, 5, 10, 20]
MUSIC_REPORT = metrics_sql(
    ([("rows", "count(*)"), ("matched", "count(*) FILTER (matched = 'True')"), ("unmatched", "count(*) FILTER (matched = 'no')"),
      ("unknown_match", "count(*) FILTER (matched IS NULL)"), ("missing_review_ids", "count(*) - count(rid)"),
      ("missing_artists", "count(*) - count(who)"), ("usable_texts", "count(*) FILTER (usable)"), ("empty_texts", "count(*) FILTER (NOT usable)"),
      ("rated", "count(rating)"), ("unrated", "count(*) - count(rating)")], "r"),
    ([("unique_review_ids", "count(*)"), ("duplicate_review_ids", "count(*) FILTER (n > 1)"), ("extra_rows", "sum(n - 1)"),
      ("conflicting_ids", "count(*) FILTER (whos > 1)")], "i"),
    ([("dataset_artists", "count(known)"), ("reviewed_artists", "count(n)"), ("known_artists", "count(*) FILTER (n IS NOT NULL AND known)"),
      ("unknown_artists", "count(*) FILTER (known IS NULL)"), ("artist_coverage", "count(*) FILTER (n IS NOT NULL AND known) / count(known)"),
      *[(f"artists_at_least_{k}", f"count(*) FILTER (n >= {k})") for k in THRESHOLDS],
      ("direct_only", "count(*) FILTER (n > 0 AND own = n)"), ("release_only", "count(*) FILTER (n > 0 AND own = 0)"), ("mixed", "count(*) FILTER (own > 0 AND own < n)")], "b"))


@query("c11_music_report", f"""
    WITH r AS (SELECT review_id AS rid, entity_id AS who, matched, {TEXT} <> '' AS usable, rating, entity_type = 'artist' AS direct FROM raw_reviews),
    i AS (SELECT rid, count(*) AS n, count(DISTINCT who) AS whos FROM r GROUP BY 1),
    p AS (SELECT who, count(*) FILTER (usable) AS n, count(*) FILTER (usable AND direct) AS own FROM r GROUP BY 1),
    k AS (SELECT who, true AS known FROM (SELECT DISTINCT source AS who FROM documents WHERE doc_id % 3 = 0 UNION SELECT mbid FROM artists)),
    b AS (SELECT * FROM p FULL JOIN k USING (who))
    {MUSIC_REPORT}""")
def c11_music(t):
    raw = t.raw_reviews.withColumnsRenamed({"entity_id": "artist_mbid", "entity_type": "original_entity_type", "review_text": "text"})
    artists = t.documents.where("doc_id % 3 = 0").select(F.col("source").alias("mbid")).union(t.artists.select("mbid"))
    return D.music_report(raw, artists, THRESHOLDS).select("metric", r6("value").alias("value"))


RESTAURANT_REPORT = metrics_sql(
    ([("businesses", "count(*)"), ("with_categories", "count(categories)"),
      ("category_restaurants", "count(*) FILTER (list_contains(list_transform(string_split(lower(categories), ','), lambda x: trim(x)), 'restaurants'))")], "business"),
    ([("unique_ids", "count(inside)"), ("map_ids", "count(known)"), ("found", "count(*) FILTER (known AND inside)"), ("missing", "count(*) FILTER (known AND inside IS NULL)"),
      ("reviews", "sum(rn)"), ("map_reviews", "sum(rn) FILTER (known)"), ("with_reviews", "count(rn) FILTER (known)"), ("review_coverage", "count(rn) FILTER (known) / count(known)"),
      ("tips", "sum(tn)"), ("map_tips", "sum(tn) FILTER (known)"), ("with_tips", "count(tn) FILTER (known)"), ("empty_map_tips", "coalesce(sum(te) FILTER (known), 0)")], "b"))


@query("c11_restaurant_report", f"""
    WITH w AS (SELECT s_name AS id, count(*) AS rn FROM documents JOIN supplier ON s_suppkey = doc_id % 10 + 1 GROUP BY 1),
    g AS (SELECT business_id AS id, count(*) AS tn, count(*) FILTER (text = 'AF') AS te FROM tips GROUP BY 1),
    k AS (SELECT business_id AS id, true AS known FROM business WHERE contains(lower(categories), 'restaurants') AND review_count >= 20),
    h AS (SELECT business_id AS id, true AS inside FROM business),
    b AS (SELECT * FROM k FULL JOIN h USING (id) FULL JOIN w USING (id) FULL JOIN g USING (id))
    {RESTAURANT_REPORT}""")
def c11_restaurants(t):
    reviews = t.documents.join(t.supplier, F.col("s_suppkey") == F.col("doc_id") % 10 + 1).select(F.col("s_name").alias("business_id"))
    tips = t.tips.withColumn("text", F.when(F.col("text") == "AF", " ").otherwise(F.col("text")))
    rows = D.restaurant_report(t.business, reviews, tips, P.filter_restaurants(t.business))
    return rows.select("metric", r6("value").alias("value"))
