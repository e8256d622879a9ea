"""Checked queries: filters, joins, linkage, set work, review preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions import constants as K
from mapwright.functions import lists as L
from mapwright.functions import text as T
from mapwright.functions import values as V
from mapwright.operators import linkage, prepare as P, ranking as R
from mapwright.plans.registry import query, r6

TAG_ORDER = ["ord", "line", "price"]

# The prepared reviews, as SQL.
PREPARED = r"""
    prepared AS (SELECT ord, review_id, entity_id, language, entity_type, useful, funny, cool,
      CASE WHEN CAST(rating AS DOUBLE) BETWEEN 1 AND 10 THEN CAST(rating AS DOUBLE) END AS rating,
      CAST(coalesce(spoiler_tag, '0') > '0' AS INTEGER) AS spoiler_tag,
      try_cast(regexp_extract(helpful, '(\d+), (\d+)', 1) AS BIGINT) AS hy,
      try_cast(regexp_extract(helpful, '(\d+), (\d+)', 2) AS BIGINT) AS ht,
      trim(regexp_replace(review_text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS review_text
      FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord) AS rn FROM raw_reviews) r
      WHERE rn = 1 AND trim(regexp_replace(review_text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) <> '')"""


def prepared(t):
    return P.prepare_reviews(t.raw_reviews, ["ord"])


# ---- filters

@query("f01_entity_filters", """
    SELECT mbid AS id FROM artists WHERE listeners >= 1000 AND NOT ambiguous
    UNION ALL SELECT business_id FROM business WHERE contains(lower(categories), 'restaurants') AND review_count >= 20
    UNION ALL SELECT CAST(movie_id AS VARCHAR) FROM ratings GROUP BY movie_id HAVING count(rating) >= 30""")
def f01(t):
    artists = P.filter_artists(t.artists).select(F.col("mbid").alias("id"))
    food = P.filter_restaurants(t.business).select("business_id")
    movies = P.rating_stats(t.ratings).where("rating_count >= 30").select(F.col("movie_id").cast("string"))
    return artists.union(food).union(movies)


@query("f02_row_validity", f"""
    WITH {PREPARED} SELECT ord, review_id, entity_id FROM prepared""")
def f02(t):
    return prepared(t).select("ord", "review_id", "entity_id")


@query("f02_rejection_counts", """
    WITH v AS (SELECT review_id, count(*) AS n FROM raw_reviews GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS input_rows, CAST(0 AS BIGINT) AS missing_entity, CAST(0 AS BIGINT) AS missing_review_id,
      CAST(sum(n - 1) AS BIGINT) AS duplicates FROM v""")
def f02_counts(t):
    return P.rejection_counts(t.raw_reviews)


@query("f03_matched_only", "SELECT ord, entity_id FROM raw_reviews WHERE matched = 'True'")
def f03(t):
    return t.raw_reviews.where(V.tri_state(F.col("matched"))).select("ord", "entity_id")


@query("f04_defined_only", """
    SELECT id FROM map_items WHERE macro_genre IS NOT NULL OR review_count > 0""")
def f04(t):
    has_base, has_reviews = F.col("macro_genre").isNotNull(), F.col("review_count") > 0
    return t.map_items.where(has_base | has_reviews).select("id")


@query("f05_numeric_only", """
    SELECT id, x FROM map_items WHERE popularity IS NOT NULL AND isfinite(x) AND isfinite(y)""")
def f05(t):
    cols = ["x", "y", "popularity"]
    return t.map_items.select("id", *[V.to_double(F.col(c)).alias(c) for c in cols]).dropna(subset=cols).select("id", "x")


@query("f06_explorer_filters", """
    SELECT id FROM map_items WHERE popularity >= 25 AND macro_genre = 'LARGE' AND cluster IN (1, 2, 3, 4)""")
def f06(t):
    return t.map_items.where(
        (F.col("popularity") >= 25) & (F.col("macro_genre") == "LARGE") & F.col("cluster").isin(1, 2, 3, 4)).select("id")


@query("f07_level_of_detail", """
    WITH s AS (SELECT id, CAST(coalesce(popularity, 0) AS DOUBLE) AS v FROM map_items),
    q AS (SELECT quantile_cont(v, 0.85) AS a, quantile_cont(v, 0.35) AS b FROM s),
    n AS (SELECT quantile_cont(v, 0.25) AS c FROM s, q WHERE v >= b)
    SELECT id, v >= a AS far, v >= b AS middle, v >= b AND v >= c AS near FROM s, q, n""")
def f07(t):
    sized = t.map_items.select("id", F.coalesce("popularity", F.lit(0.0)).alias("visual_size"))
    return R.size_quantile_levels(sized).select("id", "far", "middle", "near")


@query("f08_focus_box", """
    WITH c AS (SELECT x, y FROM places WHERE id = (SELECT min(id) FROM places WHERE domain = 'movies'))
    SELECT p.id FROM places p, c WHERE p.x > c.x - 1.5 AND p.x < c.x + 1.5 AND p.y > c.y - 1.5 AND p.y < c.y + 1.5""")
def f08(t):
    from mapwright.operators.browse import focus_box

    return focus_box(t.places, F.col("domain") == "movies").select("id")


@query("f09_domain_filter", """
    SELECT id, true AS all_domains FROM map_items UNION ALL SELECT id, false FROM map_items WHERE domain IN ('music')""")
def f09(t):
    from mapwright.operators.browse import domain_filter

    every = domain_filter(t.map_items, []).select("id", F.lit(True).alias("all_domains"))
    return every.union(domain_filter(t.map_items, ["music"]).select("id", F.lit(False)))


@query("f10_reviews_only", """
    SELECT id, review_count > 1 AS narrow FROM map_items WHERE review_count > 0""")
def f10(t):
    from mapwright.operators.browse import has_reviews

    flag = F.col("review_count") > 1
    return t.map_items.where(has_reviews(flag, F.col("review_count"))).select("id", flag.alias("narrow"))


@query("f11_title_search", """
    SELECT id, title FROM map_items WHERE contains(lower(title), 'wid') ORDER BY popularity DESC NULLS LAST, id LIMIT 10""")
def f11(t):
    from mapwright.operators.browse import title_search

    return title_search(t.map_items, "Wid", F.col("popularity")).select("id", "title")


NAMES_SQL = """
    names AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part
      UNION SELECT DISTINCT c_mktsegment FROM customer),
    hits AS (SELECT n.name, m.id, CASE WHEN m.title = lower(n.name) THEN 0 ELSE 1 END AS level, m.review_count > 0 AS defined
      FROM names n JOIN map_items m ON contains(m.title, lower(n.name))),
    resolved AS (SELECT name, id, CAST(level AS INTEGER) AS level FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY level, defined DESC, id) AS rn FROM hits) WHERE rn = 1)"""


def looked_up(t):
    parts = t.part.select(F.upper("p_name").alias("name")).union(t.part.select(F.split("p_name", " ")[0]))
    return parts.union(t.customer.select("c_mktsegment")).distinct()


@query("f12_name_resolution", f"WITH {NAMES_SQL} SELECT name, id, level FROM resolved")
def f12(t):
    from mapwright.operators.browse import resolve_names

    return resolve_names(looked_up(t), t.map_items, F.col("review_count") > 0)


@query("k12_named_profiles", f"""
    WITH {NAMES_SQL} SELECT name, id, R6(valence) AS valence, R6(wonder) AS wonder FROM resolved JOIN map_items USING (id)""")
def k12(t):
    from mapwright.operators.browse import named_profiles

    out = named_profiles(looked_up(t), t.map_items, F.col("review_count") > 0, ["valence", "wonder"])
    return out.select("name", "id", r6("valence").alias("valence"), r6("wonder").alias("wonder"))


@query("e12_resolution_rate", f"""
    WITH {NAMES_SQL} SELECT length(name) > 8 AS long_name, count(*) AS names, count(id) AS resolved, R6(count(id) / count(*)) AS rate
    FROM names LEFT JOIN resolved USING (name) GROUP BY 1""")
def e12(t):
    from mapwright.operators.browse import resolution_rate, resolve_names

    names = looked_up(t).withColumn("long_name", F.length("name") > 8)
    hits = resolve_names(names, t.map_items, F.col("review_count") > 0)
    return resolution_rate(hits, names, "long_name").withColumn("rate", r6("rate"))


# ---- joins

@query("j01_stats_to_movies", """
    SELECT s.movie_id, title, R6(a) AS avg_rating, n AS rating_count, R6(sd) AS rating_std FROM
      (SELECT movie_id, avg(rating) AS a, count(rating) AS n, stddev_samp(rating) AS sd FROM ratings GROUP BY 1) s
      LEFT JOIN movies USING (movie_id)""")
def j01(t):
    stats = P.rating_stats(t.ratings).join(t.movies, "movie_id", "left")
    return stats.select("movie_id", "title", r6("avg_rating").alias("avg_rating"), "rating_count", r6("rating_std").alias("rating_std"))


@query("j02_movies_with_stats_and_tags", """
    SELECT movie_id, title, coalesce(n, 0) AS rating_count, coalesce(k, 0) AS tag_count, md5(coalesce(tx, '')) AS tags_hash
    FROM movies LEFT JOIN (SELECT movie_id, count(rating) AS n FROM ratings GROUP BY 1) r USING (movie_id)
    LEFT JOIN (SELECT movie_id, count(tag) AS k, string_agg(tag, ' ' ORDER BY ord, line, price) AS tx FROM tags
      WHERE tag IS NOT NULL GROUP BY 1) g USING (movie_id)""")
def j02(t):
    from mapwright.operators.datasets import movies_with_all

    out = movies_with_all(t.movies, t.ratings, t.tags, TAG_ORDER)
    return out.select("movie_id", "title", "rating_count", "tag_count", F.md5("tags_text").alias("tags_hash"))


@query("j03_review_summary_join", """
    SELECT c_custkey, coalesce(n, 0) AS review_count FROM customer LEFT JOIN
      (SELECT entity_id, count(*) AS n FROM orders_as_reviews WHERE price > 300000 GROUP BY 1) s ON c_custkey = entity_id""")
def j03(t):
    summary = t.orders_as_reviews.where("price > 300000").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    c = t.customer
    return c.join(summary, c.c_custkey == summary.entity_id, "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("review_count"))


def tagged_business(t):
    tips = P.joined_text(t.tips, "business_id", "text", TAG_ORDER, "tip_text")
    joined = t.business.join(tips, "business_id", "left")
    tip, cats = T.text_or_empty(F.col("tip_text")), T.text_or_empty(F.col("categories"))
    return joined.select("business_id", tip.alias("tip_text"), F.concat(cats, F.lit(" "), tip).alias("tags_text"))


@query("j04_tip_text", """
    SELECT business_id, md5(concat(coalesce(categories, ''), ' ', coalesce(tx, ''))) AS text_hash FROM business LEFT JOIN
      (SELECT business_id, string_agg(text, ' ' ORDER BY ord, line, price) AS tx FROM tips GROUP BY 1) g USING (business_id)""")
def j04(t):
    return tagged_business(t).select("business_id", F.md5("tags_text").alias("text_hash"))


@query("p14_category_and_tips", """
    SELECT business_id, CAST(length(coalesce(tx, '')) AS INTEGER) AS tip_chars, md5(concat(coalesce(categories, ''), ' ', coalesce(tx, ''))) AS text_hash
    FROM business LEFT JOIN
      (SELECT business_id, string_agg(text, ' ' ORDER BY ord, line, price) AS tx FROM tips GROUP BY 1) g USING (business_id)""")
def p14(t):
    own = tagged_business(t)
    return own.select("business_id", F.length("tip_text").alias("tip_chars"), F.md5("tags_text").alias("text_hash"))


@query("j05_one_to_one_scores", """
    SELECT m.id, R6(v.w) AS score FROM map_items m JOIN (SELECT CAST(vec_id AS VARCHAR) AS source_id, list_extract(embedding, 20) AS w FROM embeddings) v
    USING (source_id)""")
def j05(t):
    from mapwright.operators.datasets import join_one_to_one

    scores = t.embedding_table.select(F.col("entity_id").alias("source_id"), F.col("embedding")[19].alias("w"))
    return join_one_to_one(t.map_items, scores, ["source_id"]).select("id", r6("w").alias("score"))


@query("j05_duplicate_keys", """
    SELECT movie_id, ord, count(*) AS "rows" FROM tags GROUP BY 1, 2 HAVING count(*) > 1""")
def j05_check(t):
    return P.duplicate_keys(t.tags, "movie_id", "ord")


@query("j06_display_names", """
    SELECT o.o_orderkey, n.nm AS name FROM orders o LEFT JOIN (SELECT c_custkey, min(c_name) AS nm FROM customer GROUP BY 1) n
      ON o.o_custkey = n.c_custkey""")
def j06(t):
    names = P.keep_first(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), ["o_custkey"], ["c_name"])
    return t.orders.select("o_orderkey", "o_custkey").join(names, "o_custkey", "left").select(
        "o_orderkey", F.col("c_name").alias("name"))


@query("j07_align_vectors", """
    SELECT b.entity_id, r.entity_id IS NOT NULL AS has_review, coalesce(r.review_count, 0) AS review_count,
      R6(coalesce(list_extract(r.embedding, 1), 0)) AS first_value
    FROM embedding_table b LEFT JOIN review_vectors r ON b.entity_id = r.entity_id AND b.domain = r.domain""")
def j07(t):
    from mapwright.operators.fusion import align

    out = align(t.embedding_table, t.review_vectors, 64)
    return out.select("entity_id", "has_review", "review_count", r6(F.col("review_embedding")[0]).alias("first_value"))


LINK_SQL = r"""
    cat AS (SELECT movie_id, year, key FROM (SELECT movie_id, CAST(regexp_extract(title, '\((\d{4})\)', 1) AS INTEGER) AS year,
      trim(regexp_replace(lower(regexp_replace(title, '\s*\(\d{4}\)\s*$', '')), '[^a-z0-9]+', ' ', 'g')) AS key FROM movies)),
    rev AS (SELECT ord, line, price, movie, try_cast(nullif(regexp_extract(movie, '(\d{4})', 1), '') AS INTEGER) AS year,
      trim(regexp_replace(lower(regexp_replace(regexp_replace(movie, '\s*\(\d{4}\)\s*$', ''), '\s+\([IVXLCDM]+\)\s*$', '')),
        '[^a-z0-9]+', ' ', 'g')) AS key FROM linkage_reviews),
    ky AS (SELECT key, year, count(*) AS n, min(movie_id) AS c FROM cat GROUP BY 1, 2),
    kt AS (SELECT key, count(*) AS n, min(movie_id) AS c FROM cat GROUP BY 1),
    linked AS (SELECT ord, line, price, rev.year IS NOT NULL AS dated, coalesce(ky.n, 0) AS ny, coalesce(kt.n, 0) AS nt,
        ky.c AS cy, kt.c AS ct FROM rev LEFT JOIN ky ON rev.key = ky.key AND rev.year = ky.year LEFT JOIN kt ON rev.key = kt.key),
    judged AS (SELECT ord, line, price,
      CASE WHEN (dated AND ny = 1) OR (NOT dated AND nt = 1) THEN 'accepted' WHEN (dated AND ny > 1) OR (NOT dated AND nt > 1)
        THEN 'ambiguous' ELSE 'unmatched' END AS match_status,
      CASE WHEN dated AND ny = 1 THEN 'exact_title_year' WHEN dated AND ny > 1 THEN 'exact_title_year_multiple_candidates'
        WHEN dated AND nt > 0 THEN 'title_found_but_year_mismatch' WHEN dated THEN 'no_exact_title_year_match'
        WHEN nt = 1 THEN 'unique_exact_title_without_year' WHEN nt > 1 THEN 'exact_title_multiple_candidates_without_year'
        ELSE 'no_exact_title_match' END AS match_method,
      CASE WHEN dated AND ny > 0 THEN 1.0 WHEN NOT dated AND nt = 1 THEN 0.99 ELSE 0.0 END::DOUBLE AS match_score,
      CASE WHEN dated AND ny = 1 THEN cy WHEN NOT dated AND nt = 1 THEN ct END AS movie_id FROM linked)"""


@query("j08_record_linkage", f"WITH {LINK_SQL} SELECT * FROM judged")
def j08(t):
    return linkage.link_reviews(t.linkage_reviews, t.movies).drop("movie")


@query("a22_match_report", f"""
    WITH {LINK_SQL} SELECT match_status, count(*) AS reviews, R6(count(*) / (SELECT count(*) FROM judged)) AS rate FROM judged GROUP BY 1""")
def a22(t):
    report = linkage.match_report(linkage.link_reviews(t.linkage_reviews, t.movies))
    return report.select("match_status", "reviews", r6("rate").alias("rate"))


@query("j09_reviews_of_known_entities", """
    SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j09(t):
    known = t.customer.where("c_mktsegment = 'BUILDING'")
    o = t.orders
    return o.join(known, o.o_custkey == known.c_custkey, "left_semi").select("o_orderkey")


@query("j10_coverage", """
    WITH k AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), o AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000)
    SELECT (SELECT count(DISTINCT k) FROM o WHERE k IN (FROM k)) AS matched, (SELECT count(DISTINCT k) FROM o WHERE k NOT IN (FROM k)) AS only_reviews,
      (SELECT count(*) FROM k WHERE k NOT IN (FROM o)) AS only_entities, (SELECT count(*) FROM o WHERE k NOT IN (FROM k)) AS orphan_reviews""")
def j10(t):
    reviews = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    return P.coverage(reviews, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("j11_matched_population", """
    WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48), b AS (SELECT p_partkey AS k FROM part WHERE p_size > 20)
    SELECT coalesce(a.k, b.k) AS entity, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM a FULL JOIN b ON a.k = b.k""")
def j11(t):
    from mapwright.operators.datasets import matched_population

    a = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("entity"))
    b = t.part.where("p_size > 20").select(F.col("p_partkey").alias("entity"))
    return matched_population(a, b, ["entity"])


@query("j12_union_domains", """
    SELECT concat('movies:', movie_id) AS id, 'movies' AS domain, title, NULL AS stars FROM movies
    UNION ALL SELECT concat('music:', mbid), 'music', artist_mb, NULL FROM artists
    UNION ALL SELECT concat('restaurants:', business_id), 'restaurants', name, stars FROM business""")
def j12(t):
    parts = {
        "movies": t.movies.select(F.col("movie_id").alias("source_id"), "title"),
        "music": t.artists.select(F.col("mbid").alias("source_id"), F.col("artist_mb").alias("title")),
        "restaurants": t.business.select(F.col("business_id").alias("source_id"), F.col("name").alias("title"), "stars"),
    }
    return P.union_domains(parts).select("id", "domain", "title", "stars")


@query("j13_apply_cluster_names", """
    SELECT id, cluster, CASE WHEN cluster >= 0 THEN concat(r_name, ' ', cluster) ELSE 'noise' END AS cluster_label
    FROM map_items LEFT JOIN region ON cluster % 5 = r_regionkey AND cluster >= 0""")
def j13(t):
    from mapwright.operators.naming import apply_names

    names = t.map_items.where("cluster >= 0").select("cluster").distinct().withColumn("r_regionkey", F.col("cluster") % 5)
    names = names.join(t.region, "r_regionkey").select("cluster", F.concat_ws(" ", "r_name", "cluster").alias("name"))
    items = t.map_items.withColumn("cluster_label", F.lit("noise"))
    return apply_names(items, names).select("id", "cluster", "cluster_label")


@query("j13_name_coverage", """
    SELECT cluster, 'missing' AS problem FROM (SELECT DISTINCT cluster FROM map_items WHERE cluster >= 0) WHERE cluster NOT IN (SELECT r_regionkey FROM region)
    UNION ALL SELECT r_regionkey, 'extra' FROM region WHERE r_regionkey NOT IN (SELECT cluster FROM map_items WHERE cluster >= 0)""")
def j13_check(t):
    from mapwright.operators.naming import name_coverage

    names = t.region.select(F.col("r_regionkey").alias("cluster"), F.col("r_name").alias("name"))
    return name_coverage(t.map_items, names)


# ---- sets

@query("u01_key_sets", """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000)
    SELECT 'both' AS part, k FROM a WHERE k IN (FROM b) UNION ALL SELECT 'left', k FROM a WHERE k NOT IN (FROM b)
    UNION ALL SELECT 'right', k FROM b WHERE k NOT IN (FROM a)""")
def u01(t):
    a = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")).distinct()
    b = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    both = a.intersect(b).select(F.lit("both").alias("part"), "k")
    left = a.exceptAll(b).select(F.lit("left").alias("part"), "k")
    return both.union(left).union(b.exceptAll(a).select(F.lit("right").alias("part"), "k"))


@query("u03_tag_jaccard", """
    WITH w AS (SELECT id, coalesce(list_distinct(string_split(replace(lower(categories), ', ', '|'), '|')), []) AS a,
        list_distinct(string_split(lower(title), ' ') || ['drama']) AS b FROM map_items)
    SELECT id, R6(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) END) AS jaccard FROM w""")
def u03(t):
    a = L.parse_list(F.col("categories"), "movies")
    b = F.array_distinct(F.concat(F.split(F.lower("title"), " "), F.array(F.lit("drama"))))
    return t.map_items.select("id", r6(L.jaccard(a, b)).alias("jaccard"))


@query("u04_union_with_widening", """
    SELECT s_name AS name, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer""")
def u04(t):
    s = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return s.unionByName(c, allowMissingColumns=True)


# ---- prepared reviews and their summaries

@query("c07_prepared_reviews", f"""
    WITH {PREPARED} SELECT ord, review_id, entity_id, rating, spoiler_tag, R6(CASE WHEN ht > 0 THEN hy / ht END) AS helpful_ratio,
      CAST(length(review_text) AS INTEGER) AS review_char_count, CAST(len(string_split(review_text, ' ')) AS INTEGER) AS review_word_count,
      md5(review_text) AS text_hash FROM prepared""")
def c07(t):
    return prepared(t).select(
        "ord", "review_id", "entity_id", "rating", "spoiler_tag", r6("helpful_votes.ratio").alias("helpful_ratio"),
        "review_char_count", "review_word_count", F.md5("review_text").alias("text_hash"))


@query("w01_keep_first", """
    SELECT md5(text) AS review_id, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def w01(t):
    return P.keep_first(t.documents.select(F.md5("text").alias("review_id"), "doc_id"), ["review_id"], ["doc_id"])


@query("a04_movie_review_summary", f"""
    WITH {PREPARED} SELECT entity_id, count(*) AS review_count, count(rating) AS review_rating_count, R6(avg(rating)) AS rating_mean,
      R6(stddev_samp(rating)) AS rating_std, CAST(sum(spoiler_tag) AS BIGINT) AS spoilers, R6(avg(spoiler_tag)) AS spoiler_ratio,
      R6(avg(CASE WHEN ht > 0 THEN hy / ht END)) AS helpful, R6(avg(length(review_text))) AS chars,
      R6(avg(len(string_split(review_text, ' ')))) AS words FROM prepared GROUP BY 1""")
def a04(t):
    s = P.movie_review_summary(prepared(t))
    return s.select(
        "entity_id", "review_count", "review_rating_count", r6("review_rating_mean").alias("rating_mean"),
        r6("review_rating_std").alias("rating_std"), F.col("spoiler_review_count").alias("spoilers"),
        r6("spoiler_ratio").alias("spoiler_ratio"), r6("avg_helpful_ratio").alias("helpful"),
        r6("avg_review_char_count").alias("chars"), r6("avg_review_word_count").alias("words"))


@query("a05_music_review_summary", f"""
    WITH {PREPARED} SELECT entity_id, count(*) AS review_count, R6(avg(rating)) AS rating_mean,
      count(*) FILTER (entity_type = 'artist') AS direct_artist_review_count, count(*) FILTER (entity_type = 'release') AS release_review_count,
      count(*) FILTER (entity_type = 'release_group') AS release_group_review_count FROM prepared GROUP BY 1""")
def a05(t):
    s = P.music_review_summary(prepared(t))
    return s.select("entity_id", "review_count", r6("review_rating_mean").alias("rating_mean"), *P.ENTITY_TYPES.values())


@query("a06_restaurant_review_summary", f"""
    WITH {PREPARED}, s AS (SELECT entity_id, count(*) AS n, avg(useful) AS u, avg(funny) AS f, avg(cool) AS c FROM prepared GROUP BY 1)
    SELECT i.entity_id, coalesce(n, 0) AS review_count, R6(u) AS avg_useful, R6(f) AS avg_funny, R6(c) AS avg_cool
    FROM (SELECT source AS entity_id FROM documents UNION SELECT n_name FROM nation) i LEFT JOIN s USING (entity_id)""")
def a06(t):
    ids = t.documents.select(F.col("source").alias("entity_id")).union(t.nation.select("n_name"))
    s = P.restaurant_review_summary(prepared(t), ids)
    return s.select("entity_id", "review_count", *[r6(c).alias(c) for c in ("avg_useful", "avg_funny", "avg_cool")])


@query("a16_threshold_counts", """
    WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT unnest([1, 5, 8, 10, 12, 15, 20]) AS threshold)
    SELECT threshold, count(*) FILTER (n >= threshold) AS entities FROM n, t GROUP BY 1""")
def a16(t):
    counts = t.orders.groupBy("o_custkey").count()
    return P.threshold_counts(counts, "count", [1, 5, 8, 10, 12, 15, 20])


@query("a17_quality_counts", """
    WITH p AS (SELECT CASE WHEN l_returnflag = 'A' THEN l_partkey END AS k FROM lineitem)
    SELECT count(*) AS "rows", count(*) FILTER (k IS NULL) AS nulls, count(DISTINCT k) AS distinct_values, count(k) - count(DISTINCT k) AS surplus FROM p""")
def a17(t):
    return P.quality_counts(t.lineitem.select(F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("k")), "k")


@query("a20_source_mix", """
    WITH p AS (SELECT entity_id, bool_or(priority = '1-URGENT') AS d, bool_or(priority <> '1-URGENT') AS r FROM orders_as_reviews GROUP BY 1)
    SELECT CASE WHEN d AND r THEN 'mixed' WHEN d THEN 'direct_only' ELSE 'release_only' END AS mix, count(*) AS entities FROM p GROUP BY 1""")
def a20(t):
    kind = F.when(F.col("priority") == "1-URGENT", "artist").otherwise("release")
    return P.source_mix(t.orders_as_reviews.withColumn("entity_type", kind))


@query("a21_conflicting_ids", """
    SELECT review_id, count(DISTINCT entity_id) AS entities, count(*) AS "rows" FROM raw_reviews GROUP BY 1 HAVING count(DISTINCT entity_id) > 1""")
def a21(t):
    return P.conflicting_ids(t.raw_reviews)


@query("c08_entity_texts", """
    WITH g AS (SELECT movie_id, string_agg(tag, ' ' ORDER BY ord, line, price) AS tx FROM tags WHERE tag IS NOT NULL GROUP BY 1)
    SELECT movie_id, md5(trim(regexp_replace(concat(replace(coalesce(genres, ''), '|', ' '), ' ', coalesce(tx, '')), '\\s+', ' ', 'g'))) AS text_hash,
      genres IS NOT NULL AS has_genres, tx IS NOT NULL AS has_tags FROM movies LEFT JOIN g USING (movie_id)""")
def c08(t):
    from mapwright.operators.datasets import movie_texts

    return movie_texts(t.movies, t.tags, TAG_ORDER).select(
        "movie_id", F.md5("text").alias("text_hash"), "has_genres", "has_tags")


@query("c11_quality_report", f"""
    WITH {PREPARED} SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM prepared
    UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM prepared
    UNION ALL SELECT 'rated', count(rating) FROM prepared
    UNION ALL SELECT 'useful', sum(useful) FROM prepared
    UNION ALL SELECT 'longest', max(length(review_text)) FROM prepared
    UNION ALL SELECT 'reviews_at_least_30', count(*) FROM (SELECT entity_id FROM prepared GROUP BY 1 HAVING count(*) >= 30)
    UNION ALL SELECT 'conflicting_ids', count(*) FROM (SELECT review_id FROM raw_reviews GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)""")
def c11(t):
    from mapwright.operators.datasets import quality_report

    return quality_report(t.raw_reviews, prepared(t), [30])


@query("s06_column_aliases", "SELECT c_custkey AS source_id, c_name AS title FROM customer")
def s06(t):
    aliases = {"source_id": ["source_id", "movieId", "c_custkey"], "title": ["title", "name", "c_name"]}
    return P.resolve_columns(t.customer, aliases).select("source_id", "title")


@query("s07_vector_contract", """
    SELECT count(*) AS "rows", CAST(min(len(embedding)) AS INTEGER) AS min_size, CAST(max(len(embedding)) AS INTEGER) AS max_size,
      count(*) - count(DISTINCT entity_id) AS duplicate_ids, count(*) FILTER (embedding IS NULL) AS missing FROM embedding_table""")
def s07(t):
    from mapwright.sources.vectors import vector_contract

    return vector_contract(t.embedding_table)
