"""Checked queries: neighbours and cluster statistics on the map (K rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions.constants import FEEL_DIMENSIONS
from mapwright.operators import clusters as C
from mapwright.operators import feel
from mapwright.operators import naming as N
from mapwright.operators import neighbors as NB
from mapwright.plans.registry import query, r6

BOTH = """(SELECT a.id AS qid, b.id AS rid, a.domain AS qd, b.domain AS rd, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
      FROM {t} a JOIN {t} b ON a.id <> b.id)"""


def knn_sql(table: str, k: int, where: str = "true", part: str = "'all'") -> str:
    return f"""SELECT qid, rid, part, d2, rn FROM (SELECT *, {part} AS part, row_number() OVER (PARTITION BY qid, {part} ORDER BY d2, rid) AS rn
      FROM {BOTH.format(t=table)} WHERE {where}) WHERE rn <= {k}"""


@query("k01_knn_2d", f"SELECT qid, rid, R6(sqrt(d2)) AS distance, CAST(rn AS INTEGER) AS rank FROM ({knn_sql('map_items', 5)})")
def k01(t):
    return NB.nearest_items(t.map_items, 5).withColumn("distance", r6("distance"))


@query("j15_distance_join", f"SELECT qid, rid, R6(sqrt(d2)) AS distance, CAST(rn AS INTEGER) AS rank FROM ({knn_sql('places', 5)})")
def j15(t):
    """Every part, customer and supplier; many of them share a point."""
    return NB.nearest_items(t.places, 5, tile_rows=400).withColumn("distance", r6("distance"))


@query("k02_nearest_same_domain", f"SELECT qid, rid, R6(sqrt(d2)) AS distance, CAST(rn AS INTEGER) AS rank FROM ({knn_sql('map_items', 5, 'qd = rd')})")
def k02(t):
    near = NB.nearest_by_label(t.map_items, F.col("domain"), 5, "same")
    return near.select("qid", "rid", r6("distance").alias("distance"), "rank")


@query("k02_nearest_other_domains", f"SELECT qid, part, rid, R6(sqrt(d2)) AS distance FROM ({knn_sql('map_items', 1, 'qd <> rd', 'rd')})")
def k02_other(t):
    near = NB.nearest_by_label(t.map_items, F.col("domain"), 1, "other")
    return near.select("qid", "part", "rid", r6("distance").alias("distance"))


@query("k03_m_nearest_per_domain", f"SELECT qid, part, rid, R6(sqrt(d2)) AS distance, CAST(rn AS INTEGER) AS rank FROM ({knn_sql('places', 3, 'qd <> rd', 'rd')})")
def k03(t):
    near = NB.nearest_by_label(t.places, F.col("domain"), 3, "other")
    return near.select("qid", "part", "rid", r6("distance").alias("distance"), "rank")


BANDS = """
    cuts AS (SELECT domain, quantile_cont(popularity, 0.2) AS lo, quantile_cont(popularity, 0.8) AS hi, count(popularity) AS known, min(popularity) AS a, max(popularity) AS z
      FROM {t} GROUP BY 1),
    banded AS (SELECT m.*, CASE WHEN popularity IS NULL OR known < 5 OR a = z THEN 'unknown' WHEN popularity >= hi THEN 'mainstream' WHEN popularity <= lo THEN 'niche'
      ELSE 'middle' END AS band FROM {t} m JOIN cuts USING (domain))"""


@query("k04_popularity_bands", f"""
    WITH {BANDS.format(t='map_items')} SELECT id, band FROM banded UNION ALL
    SELECT id, band FROM ({"WITH " + BANDS.format(t='places')} SELECT * FROM banded)""")
def k04(t):
    return NB.popularity_bands(t.map_items).select("id", "band").union(NB.popularity_bands(t.places).select("id", "band"))


@query("k05_nearest_by_band", f"""
    WITH {BANDS.format(t='map_items')} SELECT qid, band AS part, rid, R6(sqrt(d2)) AS distance FROM (SELECT a.id AS qid, b.id AS rid, b.band,
      (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.id, b.band ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rn
      FROM map_items a JOIN banded b ON a.id <> b.id AND b.band IN ('mainstream', 'niche')) WHERE rn = 1""")
def k05(t):
    banded = NB.popularity_bands(t.map_items)
    label = F.when(F.col("band").isin("mainstream", "niche"), F.col("band"))
    return NB.nearest_by_label(banded, label, 1).select("qid", "part", "rid", r6("distance").alias("distance"))


@query("k06_cluster_summary", """
    WITH c AS (SELECT cluster, count(*) AS size, avg(x) AS cx, avg(y) AS cy, count(DISTINCT domain) AS domains FROM map_items WHERE cluster >= 0 GROUP BY 1),
    l AS (SELECT cluster, macro_genre, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, macro_genre) AS rn FROM map_items
      WHERE cluster >= 0 AND macro_genre IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT cluster, domain, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, domain) AS rn FROM map_items WHERE cluster >= 0 GROUP BY 1, 2)
    SELECT c.cluster, size, R6(cx) AS cx, R6(cy) AS cy, l.macro_genre AS cluster_label, domains, d.domain AS main_domain, round(CAST(d.n AS DOUBLE) / size, 4) AS main_share
    FROM c LEFT JOIN l ON c.cluster = l.cluster AND l.rn = 1 JOIN d ON c.cluster = d.cluster AND d.rn = 1""")
def k06(t):
    s = C.cluster_summary(t.map_items.withColumnRenamed("macro_genre", "cluster_label"))
    return s.withColumn("cx", r6("cx")).withColumn("cy", r6("cy"))


CENTRES = """
    c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS size FROM map_items WHERE cluster >= 0 GROUP BY 1),
    own AS (SELECT id, m.cluster, domain, popularity, x, y, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS own_distance, size FROM map_items m JOIN c USING (cluster)),
    comp AS (SELECT id, other, d FROM (SELECT o.id, c.cluster AS other, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d,
      row_number() OVER (PARTITION BY id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), c.cluster) AS rn FROM own o JOIN c ON o.cluster <> c.cluster) WHERE rn = 1),
    scored AS (SELECT own.*, other, d, CASE WHEN d IS NULL THEN NULL WHEN own_distance + d = 0 THEN 0.5 ELSE d / (own_distance + d) END AS score FROM own LEFT JOIN comp USING (id))"""


@query("k07_competing_centre", f"WITH {CENTRES} SELECT id, other AS competing_cluster, R6(d) AS competing_distance FROM comp")
def k07(t):
    return C.competing_centres(t.map_items).withColumn("competing_distance", r6("competing_distance"))


STATUS_SQL = """CASE WHEN score IS NULL THEN 'No competing region' WHEN score < 0.5 THEN 'Closer to neighbouring region centre' WHEN score < 0.55 THEN 'Very near region boundary'
      WHEN score < 0.65 THEN 'Near region boundary' WHEN score < 0.8 THEN 'Inside region' ELSE 'Far from competing region' END"""


@query("k08_boundary_status", f"WITH {CENTRES} SELECT id, R6(score) AS boundary_score, {STATUS_SQL} AS boundary_status FROM scored")
def k08(t):
    s = C.item_statistics(t.map_items)
    return s.select("id", r6("boundary_score").alias("boundary_score"), "boundary_status")


@query("k09_item_statistics", f"""
    WITH {CENTRES} SELECT id, cluster, domain, R6(own_distance) AS own_distance, rank() OVER (PARTITION BY cluster ORDER BY own_distance) AS centrality_rank,
      R6(100.0 * rank() OVER (PARTITION BY cluster ORDER BY own_distance) / size) AS centrality_top_percent, size,
      CASE WHEN popularity IS NOT NULL THEN rank() OVER (PARTITION BY cluster, domain ORDER BY popularity DESC NULLS LAST) END AS popularity_rank,
      R6(CASE WHEN popularity IS NOT NULL THEN 100.0 * rank() OVER (PARTITION BY cluster, domain ORDER BY popularity DESC NULLS LAST)
        / count(popularity) OVER (PARTITION BY cluster, domain) END) AS popularity_top_percent,
      other AS competing_cluster, R6(d) AS competing_distance, R6(score) AS boundary_score, {STATUS_SQL} AS boundary_status FROM scored""")
def k09(t):
    s = C.item_statistics(t.map_items)
    for c in ("own_distance", "centrality_top_percent", "popularity_top_percent", "competing_distance", "boundary_score"):
        s = s.withColumn(c, r6(c))
    return s


FEEL_D = " + ".join(f"(a.{d} - b.{d}) * (a.{d} - b.{d})" for d in FEEL_DIMENSIONS)


@query("k10_feel_distance", f"""
    SELECT qid, rid, R6(sqrt({FEEL_D})) AS feel_distance FROM ({knn_sql('map_items', 2)}) n JOIN map_items a ON a.id = qid JOIN map_items b ON b.id = rid""")
def k10(t):
    near = NB.nearest_items(t.map_items, 2)
    left = t.map_items.select(F.col("id").alias("qid"), *[F.col(d).alias(f"l_{d}") for d in FEEL_DIMENSIONS])
    right = t.map_items.select(F.col("id").alias("rid"), *[F.col(d).alias(f"r_{d}") for d in FEEL_DIMENSIONS])
    pairs = near.join(left, "qid").join(right, "rid")
    return pairs.select("qid", "rid", r6(feel.feel_distance("l_", "r_")).alias("feel_distance"))


SECOND = "second AS (SELECT id, domain, potency AS x, tension AS y FROM map_items)"


@query("u02_neighbour_overlap", f"""
    WITH {SECOND}, a AS (SELECT qid, list(rid) AS l FROM ({knn_sql('map_items', 5)}) GROUP BY 1), b AS (SELECT qid, list(rid) AS l FROM ({knn_sql('second', 5)}) GROUP BY 1)
    SELECT qid, R6(len(list_intersect(a.l, b.l)) / len(list_distinct(a.l || b.l))) AS jaccard FROM a JOIN b USING (qid)""")
def u02(t):
    second = t.map_items.select("id", "domain", F.col("potency").alias("x"), F.col("tension").alias("y"))
    overlap = NB.neighbour_overlap(NB.nearest_items(t.map_items, 5), NB.nearest_items(second, 5))
    return overlap.withColumn("jaccard", r6("jaccard"))


@query("k11_method_comparison", f"""
    WITH {SECOND}, a AS (SELECT qid, part, list(rid) AS l, avg(sqrt(d2)) AS d FROM ({knn_sql('map_items', 3, 'qd <> rd', 'rd')}) GROUP BY 1, 2),
    b AS (SELECT qid, part, list(rid) AS l, avg(sqrt(d2)) AS d FROM ({knn_sql('second', 3, 'qd <> rd', 'rd')}) GROUP BY 1, 2)
    SELECT qid, part, CAST(len(list_intersect(a.l, b.l)) AS INTEGER) AS shared, R6(len(list_intersect(a.l, b.l)) / len(list_distinct(a.l || b.l))) AS jaccard,
      R6(a.d) AS mean_distance_a, R6(b.d) AS mean_distance_b FROM a JOIN b USING (qid, part)""")
def k11(t):
    from mapwright.operators.compare import compare_methods

    second = t.map_items.select("id", "domain", F.col("potency").alias("x"), F.col("tension").alias("y"))
    out = compare_methods(t.map_items, second, 3)
    return out.select("qid", "part", "shared", *[r6(c).alias(c) for c in ("jaccard", "mean_distance_a", "mean_distance_b")])


@query("k17_name_problems", """
    SELECT 'duplicate' AS problem, lower(trim(title)) AS key, count(*) AS clusters FROM map_items GROUP BY 2 HAVING count(*) > 1""")
def k17(t):
    return N.name_problems(t.map_items.select(F.col("id").alias("cluster"), F.col("title").alias("name")))
