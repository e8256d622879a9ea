"""Checked queries: map-quality metrics (E rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions import lists as L
from mapwright.functions.constants import FEEL_DIMENSIONS
from mapwright.operators import metrics as M
from mapwright.operators import reduce, sampling
from mapwright.plans.q_aggregates import DOMAINS, MIX_SQL
from mapwright.plans.registry import query, r6
from mapwright.sources.storage import written

K = 15


def sampled(name: str, table: str, n: int, seed: int = 42, cols: str = "*") -> str:
    return f"{name} AS (SELECT {cols} FROM {table} ORDER BY md5(concat('{seed}|', id)), id LIMIT {n})"


def mixing_sql(label: str, name: str, where: str = "true") -> str:
    """Reference sample, neighbours and vote per query, as CTEs ``{name}`` (one row)."""
    n = name
    return f"""
    {n}_p AS (SELECT id, x, y, {label} AS label FROM map_items WHERE {label} IS NOT NULL AND {where}),
    {n}_d AS (SELECT a.id AS q, a.label AS own, b.label, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rn
      FROM {n}_p a JOIN {n}_p b ON a.id <> b.id),
    {n}_c AS (SELECT q, own, label, count(*) AS n FROM {n}_d WHERE rn <= {K} GROUP BY 1, 2, 3),
    {n}_q AS (SELECT q, own, arg_min(label, (-n, label)) AS vote, -sum(n / {K} * ln(n / {K})) / ln((SELECT count(DISTINCT label) FROM {n}_p)) AS e,
      1 - coalesce(sum(n) FILTER (label = own), 0) / {K} AS c FROM {n}_c GROUP BY 1, 2),
    {n}_r AS (SELECT avg(CAST(vote = own AS INTEGER)) AS recall FROM {n}_q GROUP BY own),
    {n} AS (SELECT R6(avg(CAST(vote = own AS INTEGER))) AS knn_accuracy, R6((SELECT avg(recall) FROM {n}_r)) AS knn_balanced_accuracy,
      R6(1 / (SELECT count(DISTINCT label) FROM {n}_p)) AS chance_accuracy, R6(avg(e)) AS local_entropy, R6(avg(c)) AS cross_label_neighbor_share,
      count(*) AS query_items, (SELECT count(*) FROM {n}_p) AS reference_items FROM {n}_q)"""


def rounded(df, keep=("query_items", "reference_items")):
    return df.select(*[c if c in keep else r6(c).alias(c) for c in df.columns])


@query("e01_label_mixing", f"WITH {mixing_sql('domain', 'mix')} SELECT * FROM mix")
def e01(t):
    return rounded(M.label_mixing(t.map_items, F.col("domain"), K))


@query("e01_cluster_mixing", f"WITH {mixing_sql('CAST(cluster AS VARCHAR)', 'mix')} SELECT * FROM mix")
def e01_cluster(t):
    return rounded(M.label_mixing(t.map_items, F.col("cluster").cast("string"), K))


SAMPLED_SQL = f"""
    p AS (SELECT id, x, y, domain AS label FROM map_items QUALIFY row_number() OVER (PARTITION BY domain ORDER BY md5(concat('42|', id)), id) <= 120 // 3),
    a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat('43|', id)), id) <= 20),
    d AS (SELECT a.id AS q, a.label AS own, b.label, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rn FROM a JOIN p b ON a.id <> b.id),
    c AS (SELECT q, own, label, count(*) AS n FROM d WHERE rn <= {K} GROUP BY 1, 2, 3),
    s AS (SELECT q, own, arg_min(label, (-n, label)) AS vote, 1 - coalesce(sum(n) FILTER (label = own), 0) / {K} AS c FROM c GROUP BY 1, 2)"""


@query("e01_sampled_mixing", f"""
    WITH {SAMPLED_SQL} SELECT R6(avg(CAST(vote = own AS INTEGER))) AS knn_accuracy, R6(avg(c)) AS cross_label_neighbor_share, count(*) AS query_items, (SELECT count(*) FROM p) AS reference_items FROM s""")
def e01_sampled(t):
    out = M.label_mixing(t.map_items, F.col("domain"), K, max_reference=120, query_per_class=20)
    return out.select(r6("knn_accuracy").alias("knn_accuracy"), r6("cross_label_neighbor_share").alias("cross_label_neighbor_share"), "query_items", "reference_items")


VEC = "[" + ", ".join(FEEL_DIMENSIONS) + "]"


@query("e01_source_space_mixing", f"""
    WITH p AS (SELECT id, {VEC} AS v, domain AS label FROM map_items),
    d AS (SELECT a.id AS q, a.label AS own, b.label, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.id) AS rn
      FROM p a JOIN p b ON a.id <> b.id),
    c AS (SELECT q, own, label, count(*) AS n FROM d WHERE rn <= {K} GROUP BY 1, 2, 3),
    s AS (SELECT q, own, arg_min(label, (-n, label)) AS vote, 1 - coalesce(sum(n) FILTER (label = own), 0) / {K} AS c FROM c GROUP BY 1, 2)
    SELECT R6(avg(CAST(vote = own AS INTEGER))) AS knn_accuracy, R6(avg(c)) AS cross_label_neighbor_share, count(*) AS query_items FROM s""")
def e01_source(t):
    items = t.map_items.withColumn("v", F.array(*FEEL_DIMENSIONS))
    out = M.source_space_mixing(items, "v", F.col("domain"), 5000, 2000, K)
    return out.select(r6("knn_accuracy").alias("knn_accuracy"), r6("cross_label_neighbor_share").alias("cross_label_neighbor_share"), "query_items")


@query("e02_silhouette", f"""
    WITH p AS (SELECT id, x, y, CAST(cluster AS VARCHAR) AS label FROM map_items ORDER BY md5(concat('42|', id)), id LIMIT 5000),
    m AS (SELECT a.id, a.label AS own, b.label, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s, count(*) AS n FROM p a JOIN p b ON true GROUP BY 1, 2, 3),
    q AS (SELECT id, own, max(s / (n - 1)) FILTER (label = own) AS a, min(s / n) FILTER (label <> own) AS b FROM m GROUP BY 1, 2)
    SELECT id, own AS label, R6((b - a) / greatest(a, b)) AS silhouette FROM q""")
def e02(t):
    points = sampling.sample(t.map_items, "id", 5000).select("id", F.array("x", "y").alias("vector"), F.col("cluster").cast("string").alias("label"))
    return M.silhouette(points).withColumn("silhouette", r6("silhouette"))


QUALITY_SQL = f"""
    p AS (SELECT id, {VEC} AS v, x, y FROM map_items ORDER BY md5(concat('42|', id)), id LIMIT 3000),
    n AS (SELECT count(*) AS n, least({K}, (count(*) - 1) // 2) AS k FROM p),
    r AS (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.id) AS hi,
      row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS lo FROM p a JOIN p b ON a.id <> b.id),
    i AS (SELECT id, any_value(n) AS n, any_value(k) AS k, CAST(sum(greatest(hi - k, 0)) AS BIGINT) AS penalty, R6(count(*) FILTER (hi <= k) / any_value(k)) AS overlap
      FROM r, n WHERE lo <= k GROUP BY 1)"""


def quality_points(t):
    picked = sampling.sample(t.map_items, "id", 3000)
    return picked.select("id", F.array(*FEEL_DIMENSIONS).alias("source"), F.array("x", "y").alias("map"))


@query("e04_neighbour_preservation", f"WITH {QUALITY_SQL} SELECT * FROM i")
def e04(t):
    return M.projection_quality(quality_points(t)).withColumn("overlap", r6("overlap"))


@query("e03_trustworthiness", f"""
    WITH {QUALITY_SQL} SELECT max(n) AS n, CAST(max(k) AS BIGINT) AS k, R6(1 - 2.0 * sum(penalty) / (max(n) * max(k) * (2 * max(n) - 3 * max(k) - 1))) AS trustworthiness,
      R6(avg(overlap)) AS knn_preservation FROM i""")
def e03(t):
    s = M.quality_scores(M.projection_quality(quality_points(t)))
    return s.withColumn("trustworthiness", r6("trustworthiness")).withColumn("knn_preservation", r6("knn_preservation"))


def metrics_sql(name: str, where: str = "true", tag: str = "a") -> str:
    mix = MIX_SQL.replace("mix AS", f"{tag}_x AS").replace("scored AS", f"{tag}_s AS").replace("FROM mix", f"FROM {tag}_x").replace("WHERE cluster >= 0", f"WHERE cluster >= 0 AND {where}")
    return f"""{mixing_sql('domain', tag + '_dm', where)}, {mixing_sql("CAST(review_count > 0 AS VARCHAR)", tag + '_rm', where)}, {mix},
    {tag}_z AS (SELECT cluster, count(*) AS n FROM map_items WHERE {where} GROUP BY 1), {tag}_e AS (SELECT -sum(p * ln(p)) / ln(count(*)) AS e FROM (SELECT n / sum(n) OVER () AS p FROM {tag}_z WHERE cluster >= 0)),
    {tag}_m AS (SELECT '{name}' AS map, CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (cluster >= 0) AS clusters, CAST(coalesce(sum(n) FILTER (cluster < 0), 0) AS BIGINT) AS noise,
      R6(max(n) FILTER (cluster >= 0) / sum(n)) AS largest_share, R6((SELECT e FROM {tag}_e)) AS size_entropy,
      R6((SELECT sum(size * purity) / sum(size) FROM {tag}_s)) AS weighted_purity, R6((SELECT sum(size * entropy) / sum(size) FROM {tag}_s)) AS weighted_entropy,
      R6((SELECT knn_accuracy FROM {tag}_dm)) AS domain_accuracy, R6((SELECT local_entropy FROM {tag}_dm)) AS domain_entropy,
      R6((SELECT cross_label_neighbor_share FROM {tag}_dm)) AS cross_domain_share, R6((SELECT knn_accuracy FROM {tag}_rm)) AS review_accuracy,
      R6((SELECT cross_label_neighbor_share FROM {tag}_rm)) AS cross_review_share FROM {tag}_z)"""


FIGURES = ["largest_share", "size_entropy", "weighted_purity", "weighted_entropy", "domain_accuracy", "domain_entropy",
           "cross_domain_share", "review_accuracy", "cross_review_share"]


def metric_row(name, items):
    m = M.map_metrics(name, items, DOMAINS, K)
    return m.select("map", "items", "clusters", "noise", *[r6(c).alias(c) for c in FIGURES])


@query("e05_map_metrics", f"WITH {metrics_sql('all')} SELECT * FROM a_m")
def e05(t):
    return metric_row("all", t.map_items)


TWO = "domain IN ('movies', 'music')"


@query("e09_map_comparison", f"WITH {metrics_sql('all')}, {metrics_sql('movies_music', TWO, 'b')} SELECT * FROM a_m UNION ALL SELECT * FROM b_m")
def e09(t):
    items = t.map_items
    return metric_row("all", items).unionByName(metric_row("movies_music", items.where(TWO)))


@query("e10_matched_comparison", f"""
    WITH {metrics_sql('matched')}, second AS (SELECT * REPLACE (potency AS x, tension AS y) FROM map_items), {metrics_sql('matched', 'true', 'b').replace('FROM map_items', 'FROM second')}
    SELECT a.map, {', '.join(f'a.{f} AS a_{f}, b.{f} AS b_{f}, R6(b.{f} - a.{f}) AS diff_{f}' for f in ('domain_accuracy', 'cross_domain_share', 'weighted_purity'))} FROM a_m a JOIN b_m b ON true""")
def e10(t):
    from mapwright.operators.datasets import matched_population

    first = t.map_items
    second = first.withColumn("x", F.col("potency")).withColumn("y", F.col("tension"))
    common = matched_population(first, second, ["id"]).where("in_a AND in_b").select("id")
    a = metric_row("matched", first.join(common, "id", "left_semi"))
    b = metric_row("matched", second.join(common, "id", "left_semi"))
    out = M.compare_rows(a, b, ["map"], ["domain_accuracy", "cross_domain_share", "weighted_purity"])
    return out.select("map", *[r6(c).alias(c) for c in out.columns if c != "map"])


TOK = """CASE WHEN categories IS NULL THEN [] WHEN contains(categories, '|') THEN string_split(lower(categories), '|')
      WHEN contains(categories, ',') THEN string_split(lower(categories), ', ') ELSE [lower(categories)] END"""
COHERENCE_SQL = f"""
    f AS (SELECT id, x, y, {TOK} AS tok, macro_genre AS m FROM map_items WHERE categories IS NOT NULL),
    q AS (SELECT id FROM f),
    d AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rn,
      len(list_intersect(a.tok, b.tok)) / len(list_distinct(a.tok || b.tok)) AS j, CAST(a.m = b.m AS INTEGER) AS same FROM f a JOIN q USING (id) JOIN f b ON a.id <> b.id),
    l AS (SELECT id, row_number() OVER (ORDER BY md5(concat('42|', id)), id) AS p FROM f), r AS (SELECT id, row_number() OVER (ORDER BY md5(concat('43|', id)), id) AS p FROM f),
    z AS (SELECT l.id AS a, CASE WHEN l.id = r.id THEN nx.id ELSE r.id END AS b FROM l JOIN r USING (p) JOIN r nx ON nx.p = l.p % (SELECT count(*) FROM f) + 1),
    rp AS (SELECT len(list_intersect(fa.tok, fb.tok)) / len(list_distinct(fa.tok || fb.tok)) AS j, CAST(fa.m = fb.m AS INTEGER) AS same FROM z JOIN f fa ON fa.id = z.a JOIN f fb ON fb.id = z.b)"""


def coherence(t):
    tokens = L.parse_list(F.col("categories"), "movies")
    return M.semantic_coherence(t.map_items, tokens, F.col("macro_genre"), K)


@query("e06_semantic_coherence", f"""
    WITH {COHERENCE_SQL} SELECT id, R6(jac) AS mean_neighbor_jaccard, n AS valid_neighbor_comparisons, R6(dist) AS mean_2d_neighbor_distance FROM
      (SELECT a AS id, avg(j) AS jac, count(j) AS n, avg(d) AS dist FROM d WHERE rn <= {K} GROUP BY 1)""")
def e06(t):
    detail = coherence(t)[1]
    return detail.withColumn("mean_neighbor_jaccard", r6("mean_neighbor_jaccard")).withColumn(
        "mean_2d_neighbor_distance", r6("mean_2d_neighbor_distance"))


@query("e07_local_against_random", f"""
    WITH {COHERENCE_SQL}, s AS (SELECT avg(j) AS lj, avg(same) AS lm, count(DISTINCT a) AS q FROM d WHERE rn <= {K}), u AS (SELECT avg(j) AS rj, avg(same) AS rm FROM rp)
    SELECT q AS query_items, R6(lj) AS local_jaccard, R6(rj) AS random_jaccard, R6(lj - rj) AS gain, R6(lj / rj) AS lift, R6(lm) AS local_macro, R6(rm) AS random_macro,
      R6(lm / rm) AS macro_lift, R6((SELECT count(*) FROM f) / (SELECT count(*) FROM map_items)) AS coverage FROM s, u""")
def e07(t):
    summary = coherence(t)[0]
    return summary.select("query_items", *[r6(c).alias(c) for c in summary.columns if c != "query_items"])


@query("j14_random_pairs", f"WITH {COHERENCE_SQL} SELECT a AS id, b AS other FROM z")
def j14(t):
    return M.random_pairs(t.map_items.where("categories IS NOT NULL"), "id")


@query("e08_projection_fidelity")
def e08(t):
    """Layout of document vectors against the space it came from."""
    from mapwright.functions.constants import ENGLISH_STOPWORDS

    docs = t.documents
    vectors = written(reduce.embed_texts(docs, docs, "doc_id", "text", ENGLISH_STOPWORDS)[0], "vectors")
    # Only ids of the sample can have rows in it, so no others are placed and joined; the layout is that of all vectors.
    ids = sampling.sample(vectors.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", 3000)
    few = vectors.join(F.broadcast(ids), "doc_id", "left_semi")
    placed = few.join(reduce.layout_2d(vectors, "doc_id", only=few), "doc_id")
    points = sampling.sample(placed, "doc_id", 3000).select(
        F.col("doc_id").cast("string").alias("id"), F.col("embedding").alias("source"), F.array("x", "y").alias("map"))
    return rounded(M.quality_scores(M.projection_quality(points)), ("n", "k"))


@query("e11_feature_columns", f"SELECT CAST({len(FEEL_DIMENSIONS)} AS INTEGER) AS features, count(*) AS items FROM map_items")
def e11(t):
    items = t.map_items.select("id", *[F.col(d).alias(f"feel_z_{d}") for d in FEEL_DIMENSIONS])
    return items.agg(F.lit(len(M.feature_columns(items, "feel_z_"))).alias("features"), F.count(F.lit(1)).alias("items"))
