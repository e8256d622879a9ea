"""Checked queries: projections and scalar functions (P01-P40)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions import constants as K
from mapwright.functions import text as T
from mapwright.functions import values as V
from mapwright.operators import export as X
from mapwright.operators import histogram as H
from mapwright.plans.registry import query, r6


def sql_list(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


TITLES = "SELECT ord, line, price, movie, "


@query("p01_year_in_title", """
    SELECT movie_id, title, try_cast(nullif(regexp_extract(title, '\\((\\d{4})\\)', 1), '') AS INTEGER) AS year
    FROM movies""")
def p01(t):
    return t.movies.select("movie_id", "title", T.year_in_title(F.col("title")).alias("year"))


@query("p02_first_year", """
    SELECT ord, line, price, movie, try_cast(nullif(regexp_extract(movie, '(\\d{4})', 1), '') AS INTEGER) AS year
    FROM linkage_reviews""")
def p02(t):
    return t.linkage_reviews.select("ord", "line", "price", "movie", T.first_year(F.col("movie")).alias("year"))


@query("p03_clean_title", """
    SELECT movie_id, trim(regexp_replace(title, '\\s*\\(\\d{4}\\)\\s*$', '')) AS clean_title FROM movies""")
def p03(t):
    return t.movies.select("movie_id", T.strip_title_year(F.col("title")).alias("clean_title"))


@query("p04_clean_review_title", """
    SELECT ord, line, price, trim(regexp_replace(regexp_replace(trim(movie),
        '\\s*\\(\\d{4}(?:\\s*[-–—]\\s*\\d{0,4})?\\)\\s*$', ''), '\\s+\\([ivxlcdm]+\\)\\s*$', '', 'i')) AS clean_title
    FROM linkage_reviews""")
def p04(t):
    return t.linkage_reviews.select(
        "ord", "line", "price", T.strip_review_title(F.col("movie")).alias("clean_title"))


@query("p05_match_key", """
    SELECT ord, line, price, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(movie)), '&', 'and'),
        '\\s+\\([ivxlcdm]+\\)\\s*$', ''), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS match_key
    FROM linkage_reviews""")
def p05(t):
    return t.linkage_reviews.select("ord", "line", "price", T.match_key(F.col("movie")).alias("match_key"))


@query("p06_search_key", """
    SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', ' ', 'g'))) AS key_hash
    FROM (SELECT doc_id, concat(text, ' Dvořák Ştefan Łódź Ångström Ệ') AS x FROM documents)""")
def p06(t):
    text = F.concat("text", F.lit(" Dvořák Ştefan Łódź Ångström Ệ"))
    return t.documents.select("doc_id", F.md5(T.search_key(text)).alias("key_hash"))


@query("p07_id_key", """
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS from_float, CAST(12345678 + o_orderkey * 10000019 AS VARCHAR) AS from_large,
      CAST(o_orderkey AS VARCHAR) AS from_text, concat(o_orderkey, '.00') AS typed_text, CAST(o_orderkey AS VARCHAR) AS typed_float,
      concat(o_orderkey, '.00') AS trimmed, '' AS from_null FROM orders""")
def p07(t):
    return t.orders.select(
        "o_orderkey",
        V.id_key(F.col("o_custkey").cast("double")).alias("from_float"),
        V.id_key((F.col("o_orderkey") * 10000019 + 12345678).cast("double")).alias("from_large"),
        V.id_key(F.concat(F.lit(" "), F.col("o_orderkey"), F.lit(".00 ")), "typed").alias("typed_text"),
        V.id_key(F.col("o_orderkey").cast("double"), "typed").alias("typed_float"),
        V.id_key(F.concat(F.lit(" "), F.col("o_orderkey"), F.lit(".00 ")), "trim").alias("trimmed"),
        V.id_key(F.concat(F.lit(" "), F.col("o_orderkey"), F.lit(".00 "))).alias("from_text"),
        V.id_key(F.lit(None).cast("string")).alias("from_null"))


@query("p08_weighted_rating", """
    WITH s AS (SELECT movie_id, avg(rating) AS r, count(rating) AS v FROM ratings GROUP BY movie_id),
    g AS (SELECT avg(r) AS c, quantile_cont(CAST(v AS DOUBLE), 0.75) AS m FROM s)
    SELECT movie_id, R6((r * v + c * m) / (v + m)) AS weighted_rating FROM s, g""")
def p08(t):
    from mapwright.operators.prepare import rating_stats, weighted_rating

    return weighted_rating(rating_stats(t.ratings)).select("movie_id", r6("weighted_rating").alias("weighted_rating"))


@query("p09_popularity", """
    SELECT mbid, R6(0.6 * ln(1 + listeners) + 0.4 * ln(1 + scrobbles)) AS popularity FROM artists""")
def p09(t):
    score = V.artist_popularity(F.col("listeners"), F.col("scrobbles"))
    return t.artists.select("mbid", r6(score).alias("popularity"))


@query("p10_macro_by_member", """
    SELECT movie_id, CASE WHEN genres IS NULL THEN 'Unknown' """ + " ".join(
    f"WHEN len(list_intersect(string_split(genres, '|'), [{sql_list(m)}])) > 0 THEN '{n}'" for n, m in K.MOVIE_MACROS
) + " ELSE 'Other' END AS macro FROM movies")
def p10(t):
    return t.movies.select("movie_id", V.macro_by_member(F.col("genres"), K.MOVIE_MACROS).alias("macro"))


def _like(col, groups):
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({col}), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in groups)
    return f"CASE WHEN {col} IS NULL THEN 'Other' {whens} ELSE 'Other' END"


@query("p11_macro_by_substring", f"""
    SELECT mbid AS id, {_like('tags_lastfm', K.MUSIC_MACROS)} AS macro FROM artists
    UNION ALL SELECT business_id, {_like('categories', K.RESTAURANT_MACROS)} FROM business""")
def p11(t):
    music = t.artists.select(
        F.col("mbid").alias("id"), V.macro_by_substring(F.col("tags_lastfm"), K.MUSIC_MACROS).alias("macro"))
    food = t.business.select(
        F.col("business_id").alias("id"),
        V.macro_by_substring(F.col("categories"), K.RESTAURANT_MACROS).alias("macro"))
    return music.unionByName(food)


@query("p12_genre_count", """
    SELECT movie_id, CAST(len(string_split(coalesce(genres, ''), '|')) AS INTEGER) AS genre_count FROM movies""")
def p12(t):
    return t.movies.select("movie_id", V.part_count(F.col("genres")).alias("genre_count"))


@query("p13_tags_text", """
    SELECT mbid, replace(coalesce(tags_lastfm, ''), ';', ' ') AS tags_text FROM artists""")
def p13(t):
    return t.artists.select(
        "mbid", F.regexp_replace(T.text_or_empty(F.col("tags_lastfm")), ";", " ").alias("tags_text"))


@query("p15_semantic_text", """
    SELECT movie_id, trim(regexp_replace(regexp_replace(translate(lower(concat_ws(' ', coalesce(title, ''),
        coalesce(genres, ''), coalesce(brand, ''))), ';|,', '   '), '[^a-z0-9\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g'))
        AS semantic_text FROM movies""")
def p15(t):
    m = t.movies
    return m.select("movie_id", T.semantic_text(m.title, m.genres, m.brand).alias("semantic_text"))


@query("p16_drop_domain_words", f"""
    WITH c AS (SELECT id, list_filter(string_split(regexp_replace(trim(tags_text), '\\s+', ' ', 'g'), ' '),
      lambda w: w <> '' AND NOT list_contains([{sql_list(K.DOMAIN_VOCABULARY['movies'] + K.DOMAIN_VOCABULARY['music'])}], w)) AS ws
      FROM map_items) SELECT id, array_to_string(ws, ' ') AS text FROM c""")
def p16(t):
    vocab = K.DOMAIN_VOCABULARY["movies"] + K.DOMAIN_VOCABULARY["music"]
    return t.map_items.select("id", T.drop_words(F.col("tags_text"), vocab).alias("text"))


@query("p17_first_occurrences", """
    WITH w AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS word,
        FROM documents),
    n AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id) AS pos FROM w),
    f AS (SELECT doc_id, word FROM w GROUP BY ALL)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS n_words, md5(string_agg(word, ' ' ORDER BY word)) AS words_hash
    FROM f GROUP BY doc_id""")
def p17(t):
    plain = F.regexp_replace("text", "[^A-Za-z0-9]+", " ")
    found = F.filter(F.split(T.first_occurrences(plain), " "), lambda w: w != "")
    return t.documents.select("doc_id", found.alias("w")).where(F.size("w") > 0).select(
        "doc_id", F.size("w").alias("n_words"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("words_hash"))


@query("p18_vocabulary_member", f"""
    SELECT doc_id, len(list_filter(string_split(lower(text), ' '),
      lambda w: list_contains([{sql_list(sum(K.DOMAIN_VOCABULARY.values(), []))}], trim(w)))) AS hits FROM documents""")
def p18(t):
    vocab = sum(K.DOMAIN_VOCABULARY.values(), [])
    hits = F.filter(F.split("text", " "), lambda w: T.is_vocabulary_word(w, vocab))
    return t.documents.select("doc_id", F.size(hits).cast("bigint").alias("hits"))


@query("p19_clean_review_text", """
    SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g'))) AS clean_hash FROM documents""")
def p19(t):
    return t.documents.select("doc_id", F.md5(T.collapse_spaces(F.col("text"))).alias("clean_hash"))


@query("p20_review_body", """
    SELECT l_orderkey, l_linenumber, l_extendedprice,
      CASE WHEN l_returnflag = 'A' THEN l_linestatus WHEN l_linestatus = 'F' THEN l_returnflag
        ELSE concat(l_returnflag, chr(10), chr(10), l_linestatus) END AS body FROM lineitem""")
def p20(t):
    summary = F.when(F.col("l_returnflag") != "A", F.concat(F.lit("  "), "l_returnflag"))
    detail = F.when((F.col("l_linestatus") != "F") | (F.col("l_returnflag") == "A"), F.col("l_linestatus"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        T.review_body(summary, detail.otherwise(" ")).alias("body"))


@query("p21_helpful_votes", """
    WITH h AS (SELECT ord, try_cast(regexp_extract(helpful, '(\\d+), (\\d+)', 1) AS BIGINT) AS yes,
      try_cast(regexp_extract(helpful, '(\\d+), (\\d+)', 2) AS BIGINT) AS total FROM raw_reviews)
    SELECT ord, yes, total, R6(CASE WHEN total > 0 THEN yes / total END) AS ratio FROM h""")
def p21(t):
    return t.raw_reviews.select("ord", V.helpful_votes(F.col("helpful")).alias("h")).select(
        "ord", "h.yes", "h.total", r6("h.ratio").alias("ratio"))


@query("p22_rating_range", """
    SELECT ord, CASE WHEN CAST(rating AS DOUBLE) BETWEEN 1 AND 10 THEN CAST(rating AS DOUBLE) END AS ten,
      CASE WHEN CAST(rating AS DOUBLE) BETWEEN 1 AND 5 THEN CAST(rating AS DOUBLE) END AS five FROM raw_reviews""")
def p22(t):
    r = F.col("rating")
    return t.raw_reviews.select("ord", V.within(r, 1, 10).alias("ten"), V.within(r, 1, 5).alias("five"))


@query("p23_flags", """
    SELECT ord, CAST(coalesce(spoiler_tag, '0') > '0' AS INTEGER) AS spoiler, coalesce(matched = 'True', false) AS flag,
      CASE matched WHEN 'True' THEN true WHEN 'no' THEN false END AS tri FROM raw_reviews""")
def p23(t):
    return t.raw_reviews.select(
        "ord", V.flag_from_number(F.col("spoiler_tag")).alias("spoiler"),
        V.flag_from_text(F.col("matched")).alias("flag"), V.tri_state(F.col("matched")).alias("tri"))


@query("p24_text_counts", """
    SELECT doc_id, CAST(length(text) AS INTEGER) AS chars,
      CAST(len(list_filter(string_split(regexp_replace(text, '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS INTEGER) AS words
    FROM documents""")
def p24(t):
    return t.documents.select(
        "doc_id", F.length("text").alias("chars"), T.word_count(F.col("text")).alias("words"))


@query("p25_safe_casts", """
    SELECT event_id, value AS d, CAST(trunc(value) AS BIGINT) AS i, 3000000000 + event_id * 1000000007 AS large, CAST(NULL AS DOUBLE) AS bad,
      CAST(NULL AS DOUBLE) AS endless FROM events""")
def p25(t):
    return t.events.select(
        "event_id", V.to_double(F.concat(F.lit(" "), "value")).alias("d"),
        V.to_int(F.col("value")).alias("i"), V.to_int((F.lit(3000000000) + F.col("event_id") * 1000000007).cast("string")).alias("large"), V.to_double(F.col("event_type")).alias("bad"),
        V.to_double(F.when(F.col("value") > 50, "inf").otherwise("NaN")).alias("endless"))


@query("p26_clean_token", """
    SELECT event_id, regexp_replace(props, '^[{\\" ]+|[}\\" ]+$', '', 'g') AS token FROM events""")
def p26(t):
    return t.events.select("event_id", T.clean_token(F.col("props")).alias("token"))


@query("p27_list_to_set", f"""
    WITH s AS (SELECT id, CASE WHEN categories IS NULL THEN [] WHEN contains(id, 'music:') THEN [concat('a ', title, ', b'), 'c'] WHEN contains(categories, '|')
        THEN string_split(categories, '|') WHEN contains(categories, ',') THEN string_split(categories, ',')
        ELSE [categories] END AS parts FROM map_items)
    SELECT id, array_to_string(list_sort(list_distinct(list_transform(parts, lambda p: lower(trim(p))))), ',') AS tokens FROM s""")
def p27(t):
    from mapwright.functions.lists import parse_list

    quoted = F.concat(F.lit("['a "), F.col("title"), F.lit(", b', \"c\"]"))
    text = F.when(F.col("categories").isNotNull() & F.contains("id", F.lit("music:")), quoted).otherwise(F.col("categories"))
    return t.map_items.select("id", F.array_join(F.array_sort(parse_list(text, "movies")), ",").alias("tokens"))


@query("p28_shard_hash", """
    SELECT c_name AS id, CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(c_name, ''),
      lambda ch: CAST(unicode(ch) AS UBIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS BIGINT) AS hash,
      CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(c_name, ''),
      lambda ch: CAST(unicode(ch) AS UBIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) % 256 AS INTEGER) AS shard
    FROM customer""")
def p28(t):
    return t.customer.select(
        F.col("c_name").alias("id"), V.fnv1a32(F.col("c_name")).alias("hash"),
        V.shard_of(F.col("c_name")).alias("shard"))


@query("p29_sample_score", """
    SELECT doc_id, md5(concat('42|', source, '|', doc_id)) AS score FROM documents""")
def p29(t):
    return t.documents.select("doc_id", V.sample_score(42, F.col("source"), F.col("doc_id")).alias("score"))


@query("p30_display_fields", """
    SELECT mbid, coalesce(artist_lastfm, 'Unknown') AS title, coalesce(nullif(listeners, 0), nullif(scrobbles, 0), 7) AS popularity
    FROM artists""")
def p30(t):
    return t.artists.select(
        "mbid", X.display_title(F.lit(None).cast("string"), F.col("artist_lastfm")).alias("title"),
        X.first_nonzero(F.col("listeners"), F.col("scrobbles"), F.lit(7).cast("bigint")).alias("popularity"))


@query("p31_category_list", """
    SELECT id, coalesce(categories, macro_genre, '') AS categories, CAST(CASE WHEN coalesce(categories, macro_genre) IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n
    FROM map_items""")
def p31(t):
    cats = X.category_list(F.col("categories"), F.col("macro_genre"))
    return t.map_items.select("id", F.array_join(cats, ",").alias("categories"), F.size(cats).alias("n"))


@query("p33_global_id", """
    SELECT s_suppkey, concat('restaurants:', s_suppkey) AS id FROM supplier""")
def p33(t):
    return t.supplier.select("s_suppkey", V.global_id(F.lit(" Restaurants"), F.col("s_suppkey")).alias("id"))


@query("p34_legacy_size", """
    WITH b AS (SELECT mbid, 0.6 * ln(1 + listeners) + 0.4 * ln(1 + scrobbles) AS v FROM artists),
    g AS (SELECT min(v) AS lo, max(v) AS hi FROM b)
    SELECT mbid, R6(greatest(pow((v - lo) / (hi - lo), 1.8) * 50, 2)) AS visual_size FROM b, g""")
def p34(t):
    from mapwright.operators.ranking import min_max_size

    scored = t.artists.withColumn("v", V.artist_popularity(F.col("listeners"), F.col("scrobbles")))
    return min_max_size(scored, "v").select("mbid", r6("visual_size").alias("visual_size"))


@query("p35_feel_text", """
    SELECT id, concat(CASE WHEN valence >= 0 THEN 'positive' ELSE 'negative' END, printf(' (%+.2fσ)', valence)) AS bipolar,
      concat(CASE WHEN wonder >= 0 THEN 'high wonder' ELSE 'low wonder' END, printf(' (%+.2fσ)', wonder)) AS unipolar
    FROM map_items""")
def p35(t):
    from mapwright.operators.feel import describe_dimension

    return t.map_items.select(
        "id", describe_dimension("valence", F.col("valence")).alias("bipolar"),
        describe_dimension("wonder", F.col("wonder")).alias("unipolar"))


@query("p36_category_cleanup", """
    SELECT id, array_to_string(list_sort(list_distinct(list_transform(string_split(categories, '|'), lambda p: trim(p)))), ',') AS parts
    FROM map_items WHERE categories IS NOT NULL""")
def p36(t):
    parts = T.split_categories(F.col("categories"))
    return t.map_items.where("categories IS NOT NULL").select("id", F.array_join(F.array_sort(parts), ",").alias("parts"))


@query("p37_naming_tokens", f"""
    SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z][a-z\\-'']{{2,}}'),
      lambda w: NOT list_contains([{sql_list(K.NAMING_STOPWORDS)}], w))) AS INTEGER) AS n FROM documents""")
def p37(t):
    return t.documents.select("doc_id", F.size(T.naming_tokens(F.col("text"), K.NAMING_STOPWORDS)).alias("n"))


@query("p38_label_text", """
    SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM map_items""")
def p38(t):
    return t.map_items.select("id", T.label_text(F.col("title")).alias("label"))


@query("p39_feature_flags", """
    SELECT c_custkey, concat_ws('+', CASE WHEN c_acctbal > 0 THEN 'tags' END, CASE WHEN c_nationkey > 9 THEN 'genres' END,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'reviews' END) AS features FROM customer""")
def p39(t):
    return t.customer.select("c_custkey", X.feature_description(
        tags=F.col("c_acctbal") > 0, genres=F.col("c_nationkey") > 9,
        reviews=F.col("c_mktsegment") == "BUILDING").alias("features"))


@query("p40_artist_fields", """
    SELECT mbid, coalesce(nullif(trim(artist_lastfm), ''), artist_mb) AS title,
      coalesce(nullif(trim(country_lastfm), ''), country_mb) AS country FROM artists""")
def p40(t):
    return t.artists.select(
        "mbid", F.coalesce(V.blank_to_null(F.col("artist_lastfm")), "artist_mb").alias("title"),
        F.coalesce(V.blank_to_null(F.col("country_lastfm")), "country_mb").alias("country"))


@query("p32_item_struct", """
    SELECT id, source_id, title, domain, R6(x) AS px, R6(y) AS py, CAST(cluster AS INTEGER) AS cluster,
      R6(nullif(rating, 0)) AS rating, R6(nullif(popularity, 0)) AS popularity, tags_text AS tag,
      CAST(review_count > 0 AS VARCHAR) AS has_reviews FROM map_items""")
def p32(t):
    items = X.item_struct(t.map_items.withColumn("visual_size", F.lit(4.0)), "mixed")
    return items.select(
        "id", "source_id", "title", "domain", r6("position.x").alias("px"), r6("position.y").alias("py"),
        F.col("visual.cluster").alias("cluster"), r6("statistics.rating").alias("rating"),
        r6("statistics.popularity").alias("popularity"), F.col("text.tags")[0].alias("tag"),
        F.col("enrichment")["has_review_embedding"].alias("has_reviews"))
