"""Checked queries: sizes, ranks and top rows per group (W rows), and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions import values as V
from mapwright.functions.constants import FEEL_DIMENSIONS
from mapwright.operators import clusters as C
from mapwright.operators import feel
from mapwright.operators import naming as N
from mapwright.operators import prepare as P
from mapwright.operators import ranking as R
from mapwright.plans.q_aggregates import LONG_SQL
from mapwright.plans.registry import query, r6

PCT = "(rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2) / count(*) OVER (PARTITION BY {g})"


@query("flagship_landmarks", f"""
    WITH s AS (SELECT movie_id, avg(rating) AS r, count(rating) AS v FROM ratings GROUP BY 1), g AS (SELECT avg(r) AS c, quantile_cont(CAST(v AS DOUBLE), 0.75) AS m FROM s),
    w AS (SELECT movie_id, v AS rating_count, (r * v + c * m) / (v + m) AS weighted_rating FROM s, g),
    z AS (SELECT movie_id, title, brand, weighted_rating, rating_count, 4 + pow({PCT.format(g='1', v='rating_count')}, 1.8) * 76 AS visual_size
      FROM w JOIN movies USING (movie_id))
    SELECT brand, movie_id, title, R6(weighted_rating) AS weighted_rating, R6(visual_size) AS visual_size, CAST(rank AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rating_count DESC, movie_id) AS rank FROM z) WHERE rank <= 5""")
def flagship(t):
    rated = P.weighted_rating(P.rating_stats(t.ratings)).join(t.movies, "movie_id")
    sized = R.percentile_size(rated, "rating_count")
    top = R.top_per_group(sized, ["brand"], [F.col("visual_size").desc(), F.col("movie_id")], 5)
    return top.select("brand", "movie_id", "title", r6("weighted_rating").alias("weighted_rating"), r6("visual_size").alias("visual_size"), "rank")


@query("w02_percentile_size", f"""
    SELECT o_orderkey, R6(4 + pow({PCT.format(g='1', v='o_totalprice')}, 1.8) * 76) AS visual_size FROM orders""")
def w02(t):
    return R.percentile_size(t.orders, "o_totalprice").select("o_orderkey", r6("visual_size").alias("visual_size"))


@query("w02_missing_values", f"""
    SELECT id, R6(CASE WHEN popularity IS NULL THEN 4 ELSE 4 + pow((rank() OVER (ORDER BY popularity) + (count(*) OVER (PARTITION BY popularity) - 1) / 2)
      / (SELECT count(popularity) FROM map_items), 1.8) * 76 END) AS visual_size FROM map_items""")
def w02_missing(t):
    return R.percentile_size(t.map_items).select("id", r6("visual_size").alias("visual_size"))


@query("w03_size_per_domain", f"""
    SELECT id, R6(4 + pow({PCT.format(g='domain', v='popularity')}, 1.8) * 76) AS visual_size FROM places""")
def w03(t):
    return R.percentile_size(t.places, "popularity", ["domain"]).select("id", r6("visual_size").alias("visual_size"))


@query("k18_popularity_repair", f"""
    WITH r AS (SELECT id, domain, CASE WHEN domain = 'restaurants' THEN CAST(n AS DOUBLE) ELSE popularity END AS popularity FROM places)
    SELECT id, R6(popularity) AS popularity, R6(4 + pow({PCT.format(g='domain', v='popularity')}, 1.8) * 76) AS visual_size FROM r""")
def k18(t):
    fixed = F.when(F.col("domain") == "restaurants", F.col("n").cast("double")).otherwise(F.col("popularity"))
    out = R.percentile_size(t.places.withColumn("popularity", fixed), "popularity", ["domain"])
    return out.select("id", r6("popularity").alias("popularity"), r6("visual_size").alias("visual_size"))


@query("w04_landmarks", """
    SELECT cluster, id, CAST(rn AS INTEGER) AS rank FROM (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(popularity, 0) DESC, id) AS rn
      FROM map_items) WHERE rn <= 5""")
def w04(t):
    order = [F.coalesce("popularity", F.lit(0.0)).desc(), F.col("id")]
    return R.top_per_group(t.map_items, ["cluster"], order, 5).select("cluster", "id", "rank")


@query("w06_sampled_reviews", """
    SELECT source, doc_id, CAST(rn AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat('42|', doc_id)), doc_id) AS rn
      FROM documents) WHERE rn <= 5""")
def w06(t):
    order = [V.sample_score(42, F.col("doc_id")), F.col("doc_id")]
    return R.top_per_group(t.documents.select("source", "doc_id"), ["source"], order, 5)


@query("w07_central_items", """
    WITH c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM map_items WHERE cluster >= 0 GROUP BY 1)
    SELECT cluster, id, CAST(rn AS INTEGER) AS rank FROM (SELECT m.cluster, id, row_number() OVER (PARTITION BY m.cluster
      ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), id) AS rn FROM map_items m JOIN c USING (cluster)) WHERE rn <= 15""")
def w07(t):
    return N.central_items(t.map_items).select("cluster", "id", "rank")


@query("w08_popular_items", """
    SELECT cluster, domain, id, CAST(rn AS INTEGER) AS rank FROM (SELECT cluster, domain, id, row_number() OVER (PARTITION BY cluster, domain
      ORDER BY popularity DESC NULLS LAST, id) AS rn FROM map_items WHERE cluster >= 0) WHERE rn <= 5""")
def w08(t):
    return N.popular_items(t.map_items).select("cluster", "domain", "id", "rank")


@query("w09_popularity_rank", """
    SELECT id, CASE WHEN popularity IS NOT NULL THEN rank() OVER (PARTITION BY cluster, domain ORDER BY popularity DESC NULLS LAST) END AS popularity_rank,
      R6(CASE WHEN popularity IS NOT NULL THEN 100.0 * rank() OVER (PARTITION BY cluster, domain ORDER BY popularity DESC NULLS LAST)
        / count(popularity) OVER (PARTITION BY cluster, domain) END) AS popularity_top_percent FROM map_items WHERE cluster >= 0""")
def w09(t):
    return C.popularity_rank(t.map_items).select("id", "popularity_rank", r6("popularity_top_percent").alias("popularity_top_percent"))


@query("w10_centrality_rank", """
    WITH c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM map_items WHERE cluster >= 0 GROUP BY 1),
    d AS (SELECT m.id, m.cluster, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM map_items m JOIN c USING (cluster))
    SELECT id, R6(d) AS own_distance, rank() OVER (PARTITION BY cluster ORDER BY d) AS centrality_rank,
      R6(100.0 * rank() OVER (PARTITION BY cluster ORDER BY d) / count(*) OVER (PARTITION BY cluster)) AS centrality_top_percent FROM d""")
def w10(t):
    return C.centrality_rank(t.map_items).select(
        "id", r6("own_distance").alias("own_distance"), "centrality_rank", r6("centrality_top_percent").alias("centrality_top_percent"))


@query("w11_balanced_domains", """
    WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM places GROUP BY domain))
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY domain ORDER BY popularity DESC, md5(id), id) AS rn FROM places) JOIN m ON rn <= m""")
def w11(t):
    return R.balanced_domains(t.places, F.col("popularity")).select("id")


@query("w11_balanced_ties", """
    WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM map_items GROUP BY domain))
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY domain ORDER BY coalesce(review_count, 0) DESC, md5(id), id) AS rn FROM map_items) JOIN m ON rn <= m""")
def w11_ties(t):
    return R.balanced_domains(t.map_items, F.coalesce("review_count", F.lit(0))).select("id")


@query("w12_extremes", f"""
    WITH {LONG_SQL}, b AS (SELECT id, dimension, value, domain AS scope FROM long UNION ALL SELECT id, dimension, value, 'all_domains' FROM long)
    SELECT scope, dimension, id, 'low' AS side, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scope, dimension ORDER BY value, id) AS rn FROM b) WHERE rn <= 3
    UNION ALL SELECT scope, dimension, id, 'high', CAST(rn AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY scope, dimension ORDER BY value DESC, id) AS rn FROM b) WHERE rn <= 3""")
def w12(t):
    return feel.extremes(t.map_items, ["id"], 3).select("scope", "dimension", "id", "side", "rank")


@query("t02_smallest_and_largest", """
    SELECT * FROM (SELECT p_partkey, p_retailprice, 'small' AS side FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)
    UNION ALL SELECT * FROM (SELECT p_partkey, p_retailprice, 'large' FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)""")
def t02(t):
    p = t.part.select("p_partkey", "p_retailprice")
    small = p.orderBy("p_retailprice", "p_partkey").limit(10).withColumn("side", F.lit("small"))
    return small.union(p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).withColumn("side", F.lit("large")))


@query("t04_smallest_hashes_per_entity", """
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat('7|', o_custkey, '|', o_orderkey)), o_orderkey) AS rn
      FROM orders) WHERE rn <= 3""")
def t04(t):
    order = [V.sample_score(7, F.col("o_custkey"), F.col("o_orderkey")), F.col("o_orderkey")]
    return R.top_per_group(t.orders, ["o_custkey"], order, 3).select("o_custkey", "o_orderkey")


@query("w13_region_labels_macro", """
    WITH c AS (SELECT cluster, macro_genre, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, macro_genre) AS rn FROM map_items
      WHERE macro_genre IS NOT NULL GROUP BY 1, 2)
    SELECT m.cluster, coalesce(string_agg(macro_genre, ' / ' ORDER BY rn), 'Unknown') AS cluster_label FROM (SELECT DISTINCT cluster FROM map_items) m
    LEFT JOIN (SELECT * FROM c WHERE rn <= 2) c ON m.cluster = c.cluster GROUP BY 1""")
def w13(t):
    return N.region_labels(t.map_items.select("cluster", "macro_genre"))


@query("w13_region_labels_text", """
    WITH w AS (SELECT cluster, unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(tags_text), '[^a-z0-9\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
      lambda w: length(w) >= 3 AND w <> 'the')) AS word FROM map_items),
    c AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, word) AS rn FROM w GROUP BY 1, 2)
    SELECT cluster, string_agg(word, ' / ' ORDER BY rn) AS cluster_label FROM c WHERE rn <= 2 GROUP BY 1""")
def w13_text(t):
    return N.region_labels(t.map_items.select("cluster", F.col("tags_text").alias("semantic_text")))


@query("w14_strongest_dimensions", f"""
    WITH {LONG_SQL} SELECT id, string_agg(dimension, ',' ORDER BY rn) AS dims FROM (SELECT id, dimension, row_number() OVER (PARTITION BY id
      ORDER BY abs(value) DESC, list_position([{', '.join(repr(d) for d in FEEL_DIMENSIONS)}], dimension)) AS rn FROM long) WHERE rn <= 5 GROUP BY 1""")
def w14(t):
    top = F.transform(feel.strongest_dimensions(prefix=""), lambda e: e["dimension"])
    return t.map_items.select("id", F.array_join(top, ",").alias("dims"))


@query("w14_shared_traits", f"""
    WITH {LONG_SQL}, p AS (SELECT a.id, a.dimension, least(abs(a.value), abs(b.value)) AS w FROM long a JOIN long b ON a.dimension = b.dimension
      AND b.id = (SELECT min(id) FROM map_items WHERE domain = 'music') WHERE a.value * b.value > 0)
    SELECT m.id, coalesce(s.dims, '') AS dims FROM map_items m LEFT JOIN (SELECT id, string_agg(dimension, ',' ORDER BY rn) AS dims FROM
      (SELECT id, dimension, row_number() OVER (PARTITION BY id ORDER BY w DESC) AS rn FROM p) WHERE rn <= 5 GROUP BY 1) s USING (id)""")
def w14_shared(t):
    items = t.map_items
    one = items.where("domain = 'music'").agg(F.min_by(F.struct(*FEEL_DIMENSIONS), "id")).scalar()
    both = items.withColumn("other", one).select("id", *FEEL_DIMENSIONS, *[F.col(f"other.{d}").alias(f"o_{d}") for d in FEEL_DIMENSIONS])
    return both.select("id", F.array_join(feel.shared_traits("", "o_"), ",").alias("dims"))
