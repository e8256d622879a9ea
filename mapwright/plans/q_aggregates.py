"""Checked queries: grouped figures (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.functions.constants import FEEL_DIMENSIONS, NAMING_STOPWORDS
from mapwright.operators import browse as B
from mapwright.operators import clusters as C
from mapwright.operators import export as X
from mapwright.operators import feel, fusion
from mapwright.operators import naming as N
from mapwright.operators import prepare as P
from mapwright.operators import ranking as R
from mapwright.plans.q_scalars import sql_list
from mapwright.plans.registry import query, r6

DOMAINS = ["movies", "music", "restaurants"]


@query("a01_rating_stats", """
    SELECT movie_id, R6(avg(rating)) AS avg_rating, count(rating) AS rating_count, R6(stddev_samp(rating)) AS rating_std
    FROM ratings GROUP BY 1""")
def a01(t):
    s = P.rating_stats(t.ratings)
    return s.select("movie_id", r6("avg_rating").alias("avg_rating"), "rating_count", r6("rating_std").alias("rating_std"))


@query("a02_tag_text", """
    SELECT movie_id, string_agg(tag, ' ' ORDER BY ord, line, price) AS tags_text, count(tag) AS tags_text_count
    FROM tags WHERE tag IS NOT NULL GROUP BY 1""")
def a02(t):
    return P.joined_text(t.tags, "movie_id", "tag", ["ord", "line", "price"], "tags_text")


@query("a02_tag_text_parts", """
    SELECT movie_id, part, string_agg(tag, ' ' ORDER BY ord, line, price) AS text, count(*) AS texts FROM
      (SELECT *, (rank() OVER (PARTITION BY movie_id ORDER BY ord) - 1) // 8 AS part FROM tags WHERE tag IS NOT NULL) GROUP BY 1, 2""")
def a02_parts(t):
    """The form for keys with very many tags: no task holds more than one part."""
    return P.text_parts(t.tags, "movie_id", "tag", "ord", ["ord", "line", "price"], rows=8)


@query("a03_tip_text", """
    SELECT business_id, md5(string_agg(text, ' ' ORDER BY ord, line, price)) AS tip_hash, count(*) AS tips FROM tips GROUP BY 1""")
def a03(t):
    s = P.joined_text(t.tips, "business_id", "text", ["ord", "line", "price"], "tip")
    return s.select("business_id", F.md5("tip").alias("tip_hash"), F.col("tip_count").alias("tips"))


@query("a07_regions", """
    SELECT cluster, R6(avg(x)) AS x, R6(avg(y)) AS y, R6(avg(coalesce(popularity, 0))) AS visual_size, min(macro_genre) AS cluster_label, count(*) AS member_count
    FROM map_items GROUP BY 1""")
def a07(t):
    items = t.map_items.withColumn("visual_size", F.coalesce("popularity", F.lit(0.0))).withColumnRenamed("macro_genre", "cluster_label")
    return X.regions(items).select(
        "cluster", r6("x").alias("x"), r6("y").alias("y"), r6("visual_size").alias("visual_size"), "cluster_label", "member_count")


@query("a08_cluster_sizes", """
    WITH s AS (SELECT cluster, count(*) AS n FROM map_items GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (cluster >= 0) AS clusters, CAST(coalesce(sum(n) FILTER (cluster < 0), 0) AS BIGINT) AS noise,
      CAST(0 AS BIGINT) AS missing, max(n) FILTER (cluster >= 0) AS largest, R6(max(n) FILTER (cluster >= 0) / sum(n)) AS largest_share FROM s""")
def a08(t):
    return C.cluster_sizes(t.map_items).withColumn("largest_share", r6("largest_share"))


@query("a09_normalised_entropy", """
    WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS p,
      count(*) OVER (PARTITION BY c_nationkey) AS g FROM c)
    SELECT c_nationkey, R6(CASE WHEN max(g) > 1 THEN -sum(p * ln(p)) / ln(max(g)) ELSE 0 END) AS entropy FROM p GROUP BY 1""")
def a09(t):
    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return C.normalised_entropy(counts, ["c_nationkey"]).select("c_nationkey", r6("entropy").alias("entropy"))


MIX_SQL = """
    mix AS (SELECT cluster, count(*) AS size, count(*) FILTER (domain = 'movies') AS a, count(*) FILTER (domain = 'music') AS b,
      count(*) FILTER (domain = 'restaurants') AS c FROM map_items WHERE cluster >= 0 GROUP BY 1),
    scored AS (SELECT *, greatest(a, b, c) / size AS purity,
      -(coalesce(a / size * ln(nullif(a, 0) / size), 0) + coalesce(b / size * ln(nullif(b, 0) / size), 0) + coalesce(c / size * ln(nullif(c, 0) / size), 0)) / ln(3) AS entropy FROM mix)"""


@query("a10_cluster_domain_mix", f"""
    WITH {MIX_SQL} SELECT cluster, size, a AS count_movies, b AS count_music, c AS count_restaurants, R6(a / size) AS share_movies,
      R6(b / size) AS share_music, R6(c / size) AS share_restaurants, R6(purity) AS purity, R6(entropy) AS entropy FROM scored""")
def a10(t):
    mix = C.domain_mix(t.map_items, DOMAINS)
    return mix.select("cluster", "size", *[f"count_{d}" for d in DOMAINS],
                      *[r6(c).alias(c) for c in [f"share_{d}" for d in DOMAINS] + ["purity", "entropy"]])


@query("a11_weighted_mix", f"""
    WITH {MIX_SQL} SELECT R6(sum(size * purity) / sum(size)) AS weighted_purity, R6(sum(size * entropy) / sum(size)) AS weighted_entropy FROM scored""")
def a11(t):
    w = C.weighted_mix(C.domain_mix(t.map_items, DOMAINS))
    return w.select(*[r6(c).alias(c) for c in w.columns])


@query("a12_mean_pool", """
    WITH v AS (SELECT label, i, avg(CAST(list_extract(embedding, i) AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
    n AS (SELECT label, sqrt(sum(m * m)) AS n FROM v GROUP BY 1), c AS (SELECT label, count(*) AS review_count FROM embeddings GROUP BY 1)
    SELECT label, CAST(i - 1 AS INTEGER) AS pos, R6(m / n) AS value, review_count FROM v JOIN n USING (label) JOIN c USING (label)""")
def a12(t):
    pooled = fusion.mean_pool(t.embeddings, "label")
    return pooled.select("label", "review_count", F.posexplode("embedding").alias("pos", "v")).select(
        "label", "pos", r6("v").alias("value"), "review_count")


LONG_SQL = f"long AS (UNPIVOT (SELECT id, domain, {', '.join(FEEL_DIMENSIONS)} FROM map_items) ON {', '.join(FEEL_DIMENSIONS)} INTO NAME dimension VALUE value)"
DESCRIBE = """count(value) AS n, R6(avg(value)) AS mean, R6(stddev_samp(value)) AS std, R6(min(value)) AS "min", R6(quantile_cont(value, 0.25)) AS q25,
      R6(quantile_cont(value, 0.5)) AS median, R6(quantile_cont(value, 0.75)) AS q75, R6(max(value)) AS "max" """
FIGURES = ["mean", "std", "min", "q25", "median", "q75", "max"]


@query("a13_describe_dimensions", f"WITH {LONG_SQL} SELECT dimension, {DESCRIBE} FROM long GROUP BY 1")
def a13(t):
    return feel.describe(t.map_items).select("dimension", "n", *[r6(c).alias(c) for c in FIGURES])


@query("a14_describe_by_domain", f"WITH {LONG_SQL} SELECT domain, dimension, {DESCRIBE} FROM long GROUP BY 1, 2")
def a14(t):
    return feel.describe(t.map_items, ["domain"]).select("domain", "dimension", "n", *[r6(c).alias(c) for c in FIGURES])


@query("a15_modality_coverage", """
    WITH s AS (SELECT b.domain, r.entity_id IS NOT NULL AS hr FROM embedding_table b LEFT JOIN review_vectors r USING (domain, entity_id)),
    c AS (SELECT domain, CASE WHEN hr THEN 'base+review' ELSE 'base' END AS source, count(*) AS n FROM s GROUP BY 1, 2),
    g AS (SELECT domain, source FROM (SELECT DISTINCT domain FROM s), (SELECT unnest(['none', 'base', 'review', 'base+review']) AS source))
    SELECT g.domain, g.source, coalesce(n, 0) AS entities, R6(coalesce(n, 0) * 100 / (SELECT count(*) FROM s WHERE s.domain = g.domain)) AS percent
    FROM g LEFT JOIN c USING (domain, source)""")
def a15(t):
    fused = fusion.fuse_modalities(t.embedding_table, t.review_vectors, 64)
    return fusion.modality_coverage(fused).withColumn("percent", r6("percent"))


@query("a18_running_figures", """
    SELECT user_id, count(*) AS n, R6(avg(value)) AS mean, R6(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(value) END) AS std, R6(min(value)) AS lo, R6(max(value)) AS hi
    FROM events GROUP BY 1""")
def a18(t):
    s = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    return s.select("user_id", "n", *[r6(c).alias(c) for c in ("mean", "std", "lo", "hi")])


@query("a19_star_histogram", """
    SELECT rating AS stars, count(*) AS reviews, CAST(sum(useful) AS BIGINT) AS useful, CAST(sum(funny) AS BIGINT) AS funny, CAST(sum(cool) AS BIGINT) AS cool,
      CAST(min(ord) AS BIGINT) AS first_ord, CAST(max(ord) AS BIGINT) AS last_ord FROM raw_reviews GROUP BY 1""")
def a19(t):
    return t.raw_reviews.groupBy(F.col("rating").alias("stars")).agg(
        F.count(F.lit(1)).alias("reviews"), F.sum("useful").alias("useful"), F.sum("funny").alias("funny"),
        F.sum("cool").alias("cool"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query("a19_date_range", """
    SELECT o_orderstatus, CAST(min(o_orderdate) AS TIMESTAMP) AS earliest, max(o_orderdate) AS latest FROM orders GROUP BY 1""")
def a19_dates(t):
    return t.orders.groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"))


@query("a23_domain_composition", """
    SELECT cluster, domain, count(*) AS entity_count, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY cluster), 4) AS share
    FROM map_items WHERE cluster >= 0 GROUP BY 1, 2""")
def a23(t):
    return N.domain_composition(t.map_items)


CATS_SQL = "list_distinct(list_transform(string_split(categories, '|'), lambda p: trim(p)))"


@query("a24_dominant_categories", f"""
    WITH s AS (SELECT cluster, count(*) AS size FROM map_items WHERE cluster >= 0 GROUP BY 1),
    c AS (SELECT cluster, category, count(*) AS n FROM (SELECT cluster, unnest({CATS_SQL}) AS category FROM map_items WHERE cluster >= 0) GROUP BY 1, 2)
    SELECT cluster, category, entity_count, rank, share FROM (SELECT cluster, category, n AS entity_count, round(CAST(n AS DOUBLE) / size, 4) AS share,
      CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) AS INTEGER) AS rank FROM c JOIN s USING (cluster)) WHERE rank <= 12""")
def a24(t):
    return N.dominant_categories(t.map_items, T.split_categories(F.col("categories")))


REPS_SQL = """
    cen AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM map_items WHERE cluster >= 0 GROUP BY 1),
    cent AS (SELECT id FROM (SELECT m.id, row_number() OVER (PARTITION BY m.cluster ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), m.id) AS rn
      FROM map_items m JOIN cen USING (cluster)) WHERE rn <= 15),
    popu AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY cluster, domain ORDER BY popularity DESC NULLS LAST, id) AS rn FROM map_items
      WHERE cluster >= 0) WHERE rn <= 5),
    reps AS (SELECT * FROM map_items WHERE id IN (FROM cent) OR id IN (FROM popu))"""


@query("a25_dominant_terms", f"""
    WITH {REPS_SQL}, w AS (SELECT DISTINCT cluster, id, unnest(list_filter(regexp_extract_all(lower(tags_text), '[a-z][a-z\\-'']{{2,}}'),
      lambda w: NOT list_contains([{sql_list(NAMING_STOPWORDS)}], w))) AS term FROM reps),
    c AS (SELECT cluster, term, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT cluster, term, n AS representative_count, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS INTEGER) AS rank FROM c) WHERE rank <= 18""")
def a25(t):
    return N.dominant_terms(t.map_items)


@query("a26_cluster_feel_profile", f"""
    WITH m AS (SELECT cluster, count(*) AS n, count(*) FILTER (review_count > 0) AS k, {', '.join(f'avg({d}) FILTER (review_count > 0) AS {d}' for d in FEEL_DIMENSIONS)}
      FROM map_items WHERE cluster >= 0 GROUP BY 1)
    SELECT cluster, k AS coverage_count, round(CAST(k AS DOUBLE) / n, 4) AS coverage_share, {', '.join(f'round({d}, 4) + 0.0 AS {d}' for d in FEEL_DIMENSIONS)} FROM m""")
def a26(t):
    profiles = t.map_items.where("review_count > 0")
    return N.feel_profile(t.map_items, profiles, prefix="").drop("strongest")


EFFECTS_SQL = f"""{LONG_SQL}, g AS (SELECT dimension, avg(value) AS m, var_pop(value) * count(*) AS sst, count(*) AS n, stddev_pop(value) AS sd FROM long GROUP BY 1),
    d AS (SELECT dimension, domain, avg(value) AS dm, count(*) AS k FROM long GROUP BY 1, 2),
    effects AS (SELECT dimension, R6(sum(k * (dm - m) * (dm - m)) / max(sst)) AS eta_squared, R6(max(dm) - min(dm)) AS mean_range,
      R6((max(dm) - min(dm)) / max(sd)) AS standardised_range FROM d JOIN g USING (dimension) GROUP BY 1)"""


@query("a27_domain_effects", f"WITH {EFFECTS_SQL} SELECT * FROM effects")
def a27(t):
    e = feel.domain_effects(t.map_items)
    return e.select("dimension", *[r6(c).alias(c) for c in ("eta_squared", "mean_range", "standardised_range")])


@query("a28_correlations", f"""
    WITH {LONG_SQL} SELECT a.dimension AS left_dim, b.dimension AS right_dim, R6(corr(a.value, b.value)) AS r FROM long a JOIN long b USING (id)
    WHERE list_position([{sql_list(FEEL_DIMENSIONS)}], a.dimension) < list_position([{sql_list(FEEL_DIMENSIONS)}], b.dimension) GROUP BY 1, 2""")
def a28(t):
    return feel.correlations(t.map_items).select("left_dim", "right_dim", r6("r").alias("r"))


@query("a29_available_values", """
    SELECT DISTINCT domain AS value FROM map_items UNION SELECT DISTINCT macro_genre FROM map_items WHERE macro_genre IS NOT NULL""")
def a29(t):
    items = t.map_items
    return B.available_values(items, "domain").union(B.available_values(items, "macro_genre")).select(F.col("domain").alias("value"))


@query("a30_common_labels", """
    SELECT cluster, cluster_label FROM (SELECT cluster, macro_genre AS cluster_label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, macro_genre) AS rn
      FROM map_items WHERE cluster >= 0 AND macro_genre IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def a30(t):
    return N.common_labels(t.map_items.withColumnRenamed("macro_genre", "cluster_label"))


@query("a31_coverage_report", """
    SELECT domain, count(*) AS items, count(*) FILTER (categories IS NOT NULL) AS with_text, count(*) FILTER (review_count > 0) AS with_reviews,
      R6(100 * count(*) FILTER (review_count > 0) / count(*)) AS review_percent, R6(min(popularity)) AS lo, R6(avg(popularity)) AS mean, R6(max(popularity)) AS hi
    FROM map_items GROUP BY 1""")
def a31(t):
    s = t.map_items.groupBy("domain").agg(
        F.count(F.lit(1)).alias("items"), F.count("categories").alias("with_text"),
        F.count_if(F.col("review_count") > 0).alias("with_reviews"),
        (F.count_if(F.col("review_count") > 0) * 100 / F.count(F.lit(1))).alias("review_percent"),
        F.min("popularity").alias("lo"), F.avg("popularity").alias("mean"), F.max("popularity").alias("hi"))
    return s.select("domain", "items", "with_text", "with_reviews", *[r6(c).alias(c) for c in ("review_percent", "lo", "mean", "hi")])


@query("e13_weakest_dimensions", f"""
    WITH {LONG_SQL} SELECT dimension, R6(stddev_samp(value)) AS std FROM long GROUP BY 1 ORDER BY 2, 1 LIMIT 5""")
def e13(t):
    return feel.describe(t.map_items).select("dimension", r6("std").alias("std")).orderBy("std", "dimension").limit(5)


@query("t01_sorted_effects", f"WITH {EFFECTS_SQL} SELECT dimension, eta_squared FROM effects ORDER BY eta_squared DESC, dimension")
def t01(t):
    return feel.domain_effects(t.map_items).select("dimension", r6("eta_squared").alias("eta_squared")).orderBy(
        F.desc("eta_squared"), "dimension")


@query("t03_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def t03(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("w05_top_terms_per_group", """
    SELECT o_orderpriority, o_custkey, n, CAST(rn AS INTEGER) AS rank FROM (SELECT o_orderpriority, o_custkey, count(*) AS n,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey) AS rn FROM orders GROUP BY 1, 2) WHERE rn <= 12""")
def w05(t):
    counts = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return R.top_per_group(counts, ["o_orderpriority"], [F.col("n").desc(), F.col("o_custkey")], 12)
