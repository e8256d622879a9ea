"""Checked queries: text vectors, fusion, feel scores, layout (V rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions import vectors as VX
from mapwright.functions.constants import ENGLISH_STOPWORDS, FEEL_AXES, FEEL_DIMENSIONS, FUSION_WEIGHTS
from mapwright.operators import density, density_tree, encode, feel, fusion, metrics, reduce, sampling, tfidf
from mapwright.plans.q_scalars import sql_list
from mapwright.plans.registry import query, r6
from mapwright.sources import storage

TOKENS_SQL = f"""list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
      lambda w: NOT list_contains([{sql_list(ENGLISH_STOPWORDS)}], w))"""


def tfidf_sql(fit: str, use: str) -> str:
    return f"""
    WITH tok AS (SELECT doc_id, lang, unnest({TOKENS_SQL}) AS term FROM documents),
    v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents WHERE {fit})) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM tok WHERE {fit}
      GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000),
    w AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM tok JOIN v USING (term) WHERE {use} GROUP BY 1, 2)
    SELECT doc_id, term, R6(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))) AS weight FROM w"""


@query("v01_tfidf", tfidf_sql("true", "true"))
def v01(t):
    """Texts are dealt by id once: terms are counted and lengths taken where a text lies, so no (id, term) pair is shuffled."""
    docs = storage.spread(t.documents.select("doc_id", "text"), "doc_id")
    counts = tfidf.term_counts(docs, "doc_id", "text", ENGLISH_STOPWORDS)
    vocab = tfidf.fit_vocabulary(counts, t.documents, 5000)
    return tfidf.transform(counts, vocab, "doc_id").withColumn("weight", r6("weight"))


@query("v02_vocabulary_reuse", tfidf_sql("lang = 'en'", "lang <> 'en'"))
def v02(t):
    english, other = t.documents.where("lang = 'en'"), t.documents.where("lang <> 'en'")
    vocab = tfidf.fit_vocabulary(tfidf.term_counts(english, "doc_id", "text", ENGLISH_STOPWORDS), english, 5000)
    counts = tfidf.term_counts(other, "doc_id", "text", ENGLISH_STOPWORDS)
    return tfidf.transform(counts, vocab, "doc_id").withColumn("weight", r6("weight"))


@query("v03_truncated_svd")
def v03(t):
    """Reduced document vectors: at most 256 numbers, length one."""
    docs = t.documents
    out, fitted = reduce.embed_texts(docs, docs, "doc_id", "text", ENGLISH_STOPWORDS)
    return out.select("doc_id", F.size("embedding").alias("dims"), r6(VX.norm(F.col("embedding"))).alias("length"),
                      F.lit(round(fitted.explained, 6)).alias("explained"))


@query("v04_concat_fusion", """
    WITH f AS (SELECT b.entity_id, list_transform(CAST(b.embedding AS DOUBLE[]), lambda x: x * sqrt(0.65)) || list_transform(
      coalesce(CAST(r.embedding AS DOUBLE[]), list_transform(range(64), lambda i: 0.0)), lambda x: x * sqrt(0.35)) AS v
      FROM embedding_table b LEFT JOIN review_vectors r USING (domain, entity_id)),
    n AS (SELECT entity_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM f)
    SELECT entity_id, CAST(i - 1 AS INTEGER) AS pos, R6(v[i] / n) AS value FROM n, range(1, 129) r(i)""")
def v04(t):
    both = fusion.align(t.embedding_table, t.review_vectors, 64)
    fused = fusion.concat_fusion(F.col("embedding"), F.col("review_embedding"), 0.35)
    return both.select("entity_id", F.posexplode(fused).alias("pos", "v")).select("entity_id", "pos", r6("v").alias("value"))


@query("v05_additive_fusion", """
    WITH f AS (SELECT b.entity_id, CASE WHEN r.entity_id IS NULL THEN CAST(b.embedding AS DOUBLE[]) ELSE
      list_transform(list_zip(b.embedding, r.embedding), lambda z: CAST(z[1] AS DOUBLE) * 0.7 + CAST(z[2] AS DOUBLE) * 0.3) END AS v
      FROM embedding_table b LEFT JOIN review_vectors r USING (domain, entity_id)),
    n AS (SELECT entity_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM f)
    SELECT entity_id, CAST(i - 1 AS INTEGER) AS pos, R6(v[i] / n) AS value FROM n, range(1, 65) r(i)""")
def v05(t):
    fused = fusion.fuse_modalities(t.embedding_table, t.review_vectors, 64, 0.3)
    return fused.select("entity_id", F.posexplode("embedding").alias("pos", "v")).select("entity_id", "pos", r6("v").alias("value"))


@query("v06_modalities_of_all_domains", """
    SELECT concat(b.domain, ':', b.entity_id) AS id, b.domain, coalesce(r.review_count, 0) AS reviews_used_for_embedding,
      CAST(CASE WHEN r.entity_id IS NULL THEN 1 ELSE 3 END AS INTEGER) AS source_code, CASE WHEN r.entity_id IS NULL THEN 'base' ELSE 'base+review' END AS semantic_source
    FROM embedding_table b LEFT JOIN review_vectors r USING (domain, entity_id)""")
def v06(t):
    fused = fusion.fuse_modalities(t.embedding_table, t.review_vectors, 64)
    return fused.select("id", "domain", "reviews_used_for_embedding", F.col("source_code").cast("int").alias("source_code"), "semantic_source")


@query("v07_unit_length", """
    WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, R6(v[i] / n) AS value FROM n, range(1, 65) r(i)""")
def v07(t):
    return t.embeddings.select("vec_id", F.posexplode(VX.unit(F.col("embedding"))).alias("pos", "v")).select(
        "vec_id", "pos", r6("v").alias("value"))


ANCHOR_NAMES = [f"{d}__{label}" for d, high, low, _, _ in FEEL_AXES for label in ([high, low] if low else [high])]
SIMS_SQL = f"""
    unit AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings),
    sims AS (SELECT e.vec_id, a.vec_id AS anchor_index, [{sql_list(ANCHOR_NAMES)}][a.vec_id + 1] AS anchor_name, list_sum(list_transform(list_zip(e.u, a.u), lambda z: z[1] * z[2])) AS s
      FROM unit e JOIN unit a ON a.vec_id < {len(ANCHOR_NAMES)})"""


def similarities(t):
    """The first 23 vectors stand for the encoded anchor sentences."""
    named = feel.anchor_table(t.spark)
    anchors = F.broadcast(named).join(t.embeddings.select(F.col("vec_id").alias("anchor_index"), F.col("embedding").alias("anchor_vector")), "anchor_index")
    return feel.anchor_similarities(t.embeddings, anchors)


@query("v09_anchor_similarity", f"WITH {SIMS_SQL} SELECT vec_id, CAST(anchor_index AS INTEGER) AS anchor_index, anchor_name, R6(s) AS similarity FROM sims")
def v09(t):
    """Also covers the anchor table (V08): names and order come from it."""
    long = similarities(t).select("vec_id", F.posexplode("similarities").alias("anchor_index", "s"))
    names = feel.anchor_table(t.spark).select("anchor_index", "anchor_name")
    return long.join(F.broadcast(names), "anchor_index").select("vec_id", "anchor_index", "anchor_name", r6("s").alias("similarity"))


def score_sql() -> str:
    out, i = [], 0
    for d, _, low, _, _ in FEEL_AXES:
        expr = f"max(s) FILTER (anchor_index = {i})" + (f" - max(s) FILTER (anchor_index = {i + 1})" if low else "")
        i += 2 if low else 1
        out.append(f"CASE WHEN bool_or(defined) THEN {expr} ELSE 0 END AS {d}")
    return ", ".join(out)


SCORES_SQL = f"""{SIMS_SQL}, scores AS (SELECT vec_id, bool_or(defined) AS is_semantically_defined, {score_sql()} FROM
      (SELECT sims.*, doc_id IS NOT NULL AS defined FROM sims LEFT JOIN labels ON vec_id = doc_id) GROUP BY 1)"""


def scored(t):
    sims = similarities(t).select("vec_id", "similarities")
    known = t.labels.select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("known"))
    both = sims.join(known, "vec_id", "left")
    return feel.feel_scores(both, F.coalesce("known", F.lit(False))).drop("known")


@query("v10_feel_scores", f"WITH {SCORES_SQL} SELECT vec_id, is_semantically_defined, {', '.join(f'R6({d}) AS {d}' for d in FEEL_DIMENSIONS)} FROM scores")
def v10(t):
    return scored(t).select("vec_id", "is_semantically_defined", *[r6(d).alias(d) for d in FEEL_DIMENSIONS])


Z_SQL = ", ".join(f"R6(({d} - avg({d}) OVER ()) / coalesce(nullif(stddev_pop({d}) OVER (), 0), 1)) AS feel_z_{d}" for d in FEEL_DIMENSIONS)


@query("v11_standard_scaling", f"WITH {SCORES_SQL} SELECT vec_id, {Z_SQL} FROM scores WHERE is_semantically_defined")
def v11(t):
    defined = scored(t).where("is_semantically_defined")
    z = feel.standardise(defined, defined)
    return z.select("vec_id", *[r6(f"feel_z_{d}").alias(f"feel_z_{d}") for d in FEEL_DIMENSIONS])


@query("v12_review_embeddings", """
    SELECT entity_id, count(*) AS review_count, CAST(256 AS INTEGER) AS dims, CAST(1 AS DOUBLE) AS length FROM (SELECT entity_id, review_text, row_number() OVER (PARTITION BY entity_id
      ORDER BY md5(concat('42|', review_id)), review_id) AS rn FROM (SELECT DISTINCT entity_id, review_id, review_text FROM raw_reviews)) WHERE rn <= 50
      AND trim(review_text) <> '' GROUP BY 1""")
def v12(t):
    reviews = t.raw_reviews.select("entity_id", "review_id", "review_text").distinct()
    out = encode.review_embeddings(reviews)
    return out.select("entity_id", "review_count", F.size("embedding").alias("dims"), r6(VX.norm(F.col("embedding"))).alias("length"))


@query("v12_entity_embeddings", """
    SELECT id, tags_text <> '' AS has_base_semantics, CAST(length(trim(regexp_replace(tags_text, '\\s+', ' ', 'g'))) AS INTEGER) AS text_length FROM map_items""")
def v12_entities(t):
    return encode.entity_embeddings(t.map_items, "tags_text").select("id", "has_base_semantics", "text_length")


@query("v13_layout")
def v13(t):
    return reduce.layout_2d(t.embeddings, "vec_id").select("vec_id", r6("x").alias("x"), r6("y").alias("y"))


@query("v14_density_clusters", """
    WITH RECURSIVE b AS (SELECT quantile_cont(x, 0.01) AS x0, quantile_cont(y, 0.01) AS y0, greatest(quantile_cont(x, 0.99) - quantile_cont(x, 0.01), quantile_cont(y, 0.99) - quantile_cont(y, 0.01)) / floor(sqrt(count(*) * (9.0 / 24))) AS side FROM places),
    p AS (SELECT id, CAST(floor((x - x0) / side) AS BIGINT) AS cx, CAST(floor((y - y0) / side) AS BIGINT) AS cy FROM places, b),
    c AS (SELECT cx, cy, cx * 2147483648 + cy AS cell, count(*) AS n FROM p GROUP BY 1, 2),
    d AS (SELECT a.cx, a.cy, a.cell, a.n FROM c a JOIN c o ON abs(a.cx - o.cx) <= 1 AND abs(a.cy - o.cy) <= 1 GROUP BY ALL HAVING sum(o.n) >= {S}),
    reach AS (SELECT cell AS a, cell AS z, cx, cy FROM d UNION SELECT r.a, d.cell, d.cx, d.cy FROM reach r JOIN d ON abs(r.cx - d.cx) <= 1 AND abs(r.cy - d.cy) <= 1),
    g AS (SELECT z AS cell, min(a) AS label FROM reach GROUP BY 1),
    s AS (SELECT label, row_number() OVER (ORDER BY sum(n) DESC, label) - 1 AS cluster FROM g JOIN d USING (cell) GROUP BY 1 HAVING sum(n) >= 40)
    SELECT id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM p LEFT JOIN g ON p.cx * 2147483648 + p.cy = g.cell LEFT JOIN s USING (label)""".replace("{S}", "24"))
def v14(t):
    out = density.density_clusters(t.places, min_cluster_size=40, min_samples=24)
    return out.select("id", "cluster")


@query("v14_density_tree", """
    WITH RECURSIVE near AS (SELECT a.id AS qid, b.id AS rid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM places a JOIN places b ON a.id <> b.id
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) <= 24),
    core AS (SELECT qid AS id, max(d) AS core FROM near GROUP BY 1),
    h AS (SELECT height, row_number() OVER (ORDER BY height) - 1 AS level FROM (SELECT DISTINCT unnest(quantile_cont(core, [i / 32.0 FOR i IN range(1, 33)])) AS height FROM core)),
    rate AS (SELECT level, 1 / greatest(height, (SELECT min(height) / 2 FROM h WHERE height > 0)) AS r FROM h),
    gain AS (SELECT level, r - coalesce(lead(r) OVER (ORDER BY level), r) AS g FROM rate),
    c AS (SELECT id, core, (SELECT count(*) FROM h WHERE height < core) AS level FROM core),
    low AS (SELECT qid AS id, min({'core': core, 'id': rid}) AS least FROM near JOIN c ON rid = c.id GROUP BY 1),
    step AS (SELECT c.id, CASE WHEN least < {'core': core, 'id': c.id} THEN least.id ELSE c.id END AS down FROM c JOIN low USING (id)),
    walk AS (SELECT id, down FROM step UNION SELECT w.id, s.down FROM walk w JOIN step s ON w.down = s.id),
    p AS (SELECT c.id, c.core, c.level, s.id AS basin FROM walk w JOIN step s ON w.down = s.id AND s.down = s.id JOIN c ON c.id = w.id),
    pass AS (SELECT a.basin AS a, b.basin AS b, min(greatest(a.core, b.core)) AS height FROM near JOIN p a ON qid = a.id JOIN p b ON rid = b.id WHERE a.basin <> b.basin GROUP BY 1, 2),
    edge AS (SELECT DISTINCT level, x.a, x.b FROM (SELECT a, b, height FROM pass UNION ALL SELECT b, a, height FROM pass) x JOIN h ON x.height <= h.height),
    node AS (SELECT h.level, basin FROM p JOIN h ON p.level <= h.level WHERE p.id = basin),
    reach AS (SELECT level, basin AS a, basin AS z FROM node UNION SELECT r.level, r.a, e.b FROM reach r JOIN edge e ON e.level = r.level AND e.a = r.z),
    lab AS (SELECT level, z AS basin, min(a) AS label FROM reach GROUP BY 1, 2),
    grp AS (SELECT lab.level, label, count(*) AS size FROM lab JOIN p ON p.basin = lab.basin AND p.level <= lab.level GROUP BY 1, 2 HAVING count(*) >= 40),
    tied AS (SELECT g.*, u.label AS up, count(*) OVER (PARTITION BY g.level, u.label) AS siblings FROM grp g LEFT JOIN lab u ON u.level = g.level + 1 AND u.basin = g.label),
    head AS (SELECT level, label, size FROM tied WHERE up IS NULL OR siblings > 1),
    held AS (SELECT g.level, g.label, g.size, h.level AS up_level, h.label AS up_label FROM grp g JOIN lab o ON o.basin = g.label AND o.level >= g.level JOIN head h ON h.level = o.level AND h.label = o.label),
    own AS (SELECT up.l AS level, up.b AS label, sum(size * g) AS own FROM (SELECT level, size, min({'l': up_level, 'b': up_label}) AS up FROM held GROUP BY level, label, size) JOIN gain USING (level) GROUP BY 1, 2),
    line AS (SELECT held.* FROM held JOIN head USING (level, label) WHERE up_level > held.level),
    tree AS (SELECT head.level, head.label, head.size, own, coalesce(depth, 0) AS depth, up FROM head JOIN own USING (level, label)
      LEFT JOIN (SELECT level, label, count(*) AS depth, min({'l': up_level, 'b': up_label}) AS up FROM line GROUP BY 1, 2) USING (level, label)),
    cut AS (SELECT level, label, size, depth, up, own AS total, size < (SELECT count(*) FROM p) AS keep FROM tree WHERE depth = (SELECT max(depth) FROM tree)
      UNION ALL SELECT t.level, t.label, t.size, t.depth, t.up, CASE WHEN t.size < (SELECT count(*) FROM p) AND own >= coalesce(sub, 0) THEN own ELSE coalesce(sub, 0) END,
        t.size < (SELECT count(*) FROM p) AND own >= coalesce(sub, 0)
      FROM tree t JOIN (SELECT max(depth) - 1 AS depth FROM cut) d ON t.depth = d.depth LEFT JOIN (SELECT up, sum(total) AS sub FROM cut GROUP BY 1) k ON k.up = {'l': t.level, 'b': t.label}),
    best AS (SELECT level, label, row_number() OVER (ORDER BY size DESC, level, label) - 1 AS cluster FROM cut
      WHERE keep AND NOT EXISTS (SELECT 1 FROM line JOIN cut o ON o.level = up_level AND o.label = up_label AND o.keep WHERE line.level = cut.level AND line.label = cut.label)),
    member AS (SELECT p.id, cluster FROM best JOIN lab USING (level, label) JOIN p ON p.basin = lab.basin AND p.level <= best.level)
    SELECT places.id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM places LEFT JOIN member USING (id)""")
def v14_tree(t):
    """Clusters of many densities, with the least size and the neighbours of the grid's query."""
    return density_tree.density_tree_clusters(t.places, min_cluster_size=40, min_samples=24).select("id", "cluster")


def sweep_points(t):
    both = t.embedding_table.join(t.review_vectors.select("domain", "entity_id", F.col("embedding").alias("second"), "review_count"), ["domain", "entity_id"])
    eligible = (F.col("review_count") >= 1) & (VX.norm(F.col("embedding")) > 0) & (VX.norm(F.col("second")) > 0)
    picked = sampling.evaluation_sample(both, "entity_id", eligible, 3000)
    return picked.select(F.col("entity_id").alias("id"), VX.unit(F.col("embedding")).alias("base"), VX.unit(F.col("second")).alias("review"))


UNIT = "list_transform(CAST({v} AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST({v} AS DOUBLE[]), lambda y: y * y))))"
SWEEP_SQL = f"""
    p AS (SELECT b.entity_id AS id, {UNIT.format(v='b.embedding')} AS a, {UNIT.format(v='r.embedding')} AS r FROM embedding_table b JOIN review_vectors r USING (domain, entity_id)
      ORDER BY md5(concat('42|', b.entity_id)), b.entity_id LIMIT 3000),
    s AS (SELECT x.id AS q, y.id AS n, list_inner_product(x.a, y.a) AS sa, list_inner_product(x.r, y.r) AS sr FROM p x JOIN p y ON x.id <> y.id),
    k AS (SELECT w, q, sa, sr, row_number() OVER (PARTITION BY w, q ORDER BY (1 - w) * sa + w * sr DESC, n) AS rn FROM s, (SELECT CAST(unnest({FUSION_WEIGHTS}) AS DOUBLE) AS w)),
    m AS (SELECT w AS weight, avg(sa) AS ba, avg(sr) AS re FROM k WHERE rn <= 15 GROUP BY 1),
    sweep AS (SELECT weight, R6(ba) AS base_similarity, R6(re) AS review_similarity, R6(2 * ((ba + 1) / 2) * ((re + 1) / 2) / ((ba + 1) / 2 + (re + 1) / 2)) AS balance FROM m)"""


@query("v15_fusion_weight_sweep", f"WITH {SWEEP_SQL} SELECT * FROM sweep")
def v15(t):
    s = metrics.fusion_weight_sweep(sweep_points(t))
    return s.select("weight", *[r6(c).alias(c) for c in ("base_similarity", "review_similarity", "balance")])


@query("t05_best_weight", f"WITH {SWEEP_SQL} SELECT weight, balance FROM sweep ORDER BY balance DESC, weight LIMIT 1")
def t05(t):
    return metrics.best_weight(metrics.fusion_weight_sweep(sweep_points(t))).withColumn("balance", r6("balance"))


@query("v16_evaluation_sample", """
    SELECT entity_id FROM embedding_table JOIN review_vectors USING (domain, entity_id) WHERE review_count >= 2 ORDER BY md5(concat('42|', entity_id)), entity_id LIMIT 100""")
def v16(t):
    both = t.embedding_table.join(t.review_vectors.select("domain", "entity_id", "review_count"), ["domain", "entity_id"])
    eligible = (F.col("review_count") >= 2) & (VX.norm(F.col("embedding")) > 0)
    return sampling.evaluation_sample(both, "entity_id", eligible, 100).select("entity_id")


@query("v17_samples", """
    SELECT 'uniform' AS kind, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY md5(concat('42|', o_orderkey)), o_orderkey LIMIT 500)
    UNION ALL SELECT 'per_class', o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('42|', o_orderkey)), o_orderkey) AS rn FROM orders) WHERE rn <= 100""")
def v17(t):
    orders = t.orders.select("o_orderkey", "o_orderpriority")
    uniform = sampling.sample(orders, "o_orderkey", 500).select(F.lit("uniform").alias("kind"), "o_orderkey")
    return uniform.union(sampling.sample_per_class(orders, "o_orderkey", "o_orderpriority", 100).select(F.lit("per_class"), "o_orderkey"))
