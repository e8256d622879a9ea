"""Checked queries: sources, sinks, item details and naming records (S and K rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.functions.constants import FEEL_DIMENSIONS
from mapwright.operators import details as D
from mapwright.operators import export as X
from mapwright.operators import feel, fusion, naming
from mapwright.plans.q_aggregates import REPS_SQL
from mapwright.plans.q_prepare import PREPARED, prepared
from mapwright.plans.registry import query, r6
from mapwright.sources import readers, storage, vectors, writers

FNV = """CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split({c}, ''), lambda ch: CAST(unicode(ch) AS UBIGINT))),
      lambda a, b: (xor(a, b) * 16777619) % 4294967296) % 256 AS INTEGER)"""


@query("s01_csv_scan", """SELECT CAST(movie_id AS INTEGER) AS movieId, concat('"The", ', title) AS title, genres, CAST(NULL AS DOUBLE) AS rating FROM movies""")
def s01(t):
    path = storage.scratch_folder(t.spark, "csv")
    # Columns in another order than the schema's, quoted commas and quotes, and a number that is none.
    t.movies.select(F.lit("NaN").alias("rating"), "genres", F.concat(F.lit('"The", '), "title").alias("title"), F.col("movie_id").cast("int").alias("movieId")).write.csv(path, header=True, quote='"', escape='"')
    return readers.read_csv(t.spark, path, f"{readers.MOVIES}, rating double")


@query("s02_json_lines_scan", "SELECT business_id, name, categories, stars, CAST(review_count AS INTEGER) AS review_count FROM business")
def s02(t):
    path = storage.scratch_folder(t.spark, "jsonl")
    t.business.select("business_id", "name", "categories", "stars", "review_count").write.json(path)
    return readers.read_json_lines(t.spark, path, readers.BUSINESS).select("business_id", "name", "categories", "stars", "review_count")


@query("s03_json_array_scan", """SELECT CAST(c_custkey AS VARCHAR) AS review_id, concat('} {', c_name, '"') AS reviewer, c_mktsegment AS movie FROM customer""")
def s03(t):
    """Files with a JSON array each and files with objects one after another, landed as parquet."""
    path = storage.scratch_folder(t.spark, "arrays")
    rows = t.customer.select(
        F.floor(F.col("c_custkey") / 500).alias("file"),
        F.struct(F.col("c_custkey").cast("string").alias("review_id"), F.concat(F.lit("} {"), "c_name", F.lit('"')).alias("reviewer"), F.col("c_mktsegment").alias("movie")).alias("r"))
    arrays = rows.where("file % 2 = 0").groupBy("file").agg(F.to_json(F.collect_list("r")).alias("value"))
    objects = rows.where("file % 2 = 1").groupBy("file").agg(F.array_join(F.collect_list(F.to_json("r")), " ").alias("value"))
    arrays.unionByName(objects).write.partitionBy("file").text(path)
    raw = readers.read_json_array(t.spark, f"{path}/file=*", readers.RAW_MOVIE_REVIEW)
    return readers.land(raw, storage.scratch_folder(t.spark, "landed")).select("review_id", "reviewer", "movie")


@query("s04_chunked_ingest", f"WITH {PREPARED} SELECT entity_id, count(*) AS reviews FROM prepared GROUP BY 1")
def s04(t):
    """One plan over all files in place of chunks that carry a set of seen ids."""
    return prepared(t).groupBy("entity_id").agg(F.count(F.lit(1)).alias("reviews"))


@query("s05_pruned_scan", "SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1")
def s05(t):
    recent = t.lineitem.where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return recent.groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))


@query("s08_vector_table", """SELECT count(*) AS "rows", CAST(min(len(embedding)) AS BIGINT) AS min_size, CAST(max(len(embedding)) AS BIGINT) AS max_size,
    CAST(0 AS BIGINT) AS duplicate_ids, CAST(0 AS BIGINT) AS missing, 'given' AS model FROM embedding_table""")
def s08(t):
    path = storage.scratch_folder(t.spark, "vectors")
    vectors.write_vectors(t.embedding_table, path, "given")
    return t.spark.read.schema("rows bigint, min_size bigint, max_size bigint, duplicate_ids bigint, missing bigint, model string").json(f"{path}/metadata")


def sized_items(t):
    from mapwright.operators.ranking import percentile_size

    return percentile_size(t.map_items).withColumn("cluster_label", F.col("macro_genre"))


@query("s09_bundle", """
    SELECT 'items' AS part, id AS key, CAST(cluster AS BIGINT) AS cluster, R6(x) AS x FROM map_items
    UNION ALL SELECT 'regions', CAST(count(*) AS VARCHAR), cluster, R6(avg(x)) FROM map_items GROUP BY cluster
    UNION ALL SELECT 'landmarks', id, cluster, R6(x) FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(popularity, 0) DESC, id) AS rn FROM map_items) WHERE rn <= 5""")
def s09(t):
    path = storage.scratch_folder(t.spark, "bundle")
    writers.write_bundle(sized_items(t), path, "mixed")
    items = readers.read_map_items(t.spark, f"{path}/items", "id string, position struct<x:double,y:double>, visual struct<cluster:int>")
    regions = t.spark.read.schema("cluster bigint, x double, member_count bigint").json(f"{path}/regions")
    marks = t.spark.read.schema("cluster bigint, id string, x double").json(f"{path}/landmarks")
    out = items.select(F.lit("items").alias("part"), F.col("id").alias("key"), F.col("cluster_id").cast("bigint").alias("cluster"), r6("position.x").alias("x"))
    out = out.union(regions.select(F.lit("regions"), F.col("member_count").cast("string"), "cluster", r6("x")))
    return out.union(marks.select(F.lit("landmarks"), "id", "cluster", r6("x")))


@query("s10_json_safe", "SELECT id, popularity IS NULL AS is_null, true AS has_field FROM map_items")
def s10(t):
    bad = t.map_items.select("id", F.struct(F.coalesce("popularity", F.lit(float("nan"))).alias("p"), F.array(F.lit(float("inf"))).alias("a")).alias("s"))
    docs = X.as_json(bad, "doc")
    return docs.select(F.get_json_object("doc", "$.id").alias("id"), F.get_json_object("doc", "$.s.p").isNull().alias("is_null"),
                       F.contains("doc", F.lit('"p":')).alias("has_field"))


@query("s11_sharded_sink", f"""
    WITH d AS (SELECT domain, {FNV.format(c='source_id')} AS shard, count(*) AS n FROM map_items GROUP BY 1, 2)
    SELECT g.domain, g.shard, coalesce(n, 0) AS "count" FROM (SELECT DISTINCT domain, CAST(s AS INTEGER) AS shard FROM map_items, range(256) r(s)) g LEFT JOIN d USING (domain, shard)""")
def s11(t):
    path = storage.scratch_folder(t.spark, "shards")
    writers.write_shards(t.map_items.select("domain", "source_id", "title", "popularity"), path)
    items, index = writers.read_shards(t.spark, path, "source_id string, title string, popularity double")
    # What lies in the files, one a shard, against the documents that are read back and what the index promises.
    held = items.groupBy("domain", "shard").agg(F.count("source_id").alias("held"))
    files = writers.shard_files(t.spark, path).withColumnRenamed("count", "lines")
    both = files.join(index, ["domain", "shard"], "full").join(held, ["domain", "shard"], "left")
    same = (F.col("files") == 1) & (F.col("lines") == F.col("count")) & (F.col("lines") == F.coalesce("held", F.lit(0)))
    return both.select("domain", "shard", F.when(same, F.col("count")).alias("count"))


@query("s12_manifest", f"""
    SELECT CAST(256 AS INTEGER) AS shard_count, (SELECT string_agg(concat(domain, '=', n), ',' ORDER BY domain) FROM (SELECT domain, count(*) AS n FROM map_items GROUP BY 1)) AS domain_counts,
      R6(avg(valence)) AS valence_mean, R6(stddev_pop(wonder)) AS wonder_scale FROM map_items""")
def s12(t):
    m = writers.manifest(t.map_items, feel.scaler(t.map_items))
    pairs = F.transform(F.map_entries("domain_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("shard_count", F.array_join(pairs, ",").alias("domain_counts"), r6("scaler.valence_mean").alias("valence_mean"),
                    r6("scaler.wonder_scale").alias("wonder_scale"))


@query("s13_read_back", "SELECT id, CAST(cluster AS INTEGER) AS cluster_id FROM map_items")
def s13(t):
    path = storage.scratch_folder(t.spark, "nodes")
    nodes = t.map_items.select("id", F.struct(F.col("cluster").alias("id")).alias("region"), F.lit(None).cast("int").alias("cluster"))
    nodes.write.option("ignoreNullFields", "false").json(path)
    return readers.read_map_items(t.spark, path, "id string, cluster int, region struct<id:int>").select("id", "cluster_id")


def z_profiles(t):
    known = t.map_items.where("review_count > 0")
    return feel.standardise(known, known).select("id", *[f"feel_z_{d}" for d in FEEL_DIMENSIONS])


def records(t):
    items = t.map_items.withColumn("cluster_label", F.col("macro_genre"))
    return naming.naming_records("movies_music_restaurants_feel", items, z_profiles(t), T.split_categories(F.col("categories")))


@query("k15_naming_records", f"""
    WITH {REPS_SQL}, s AS (SELECT cluster, count(*) AS size, avg(x) AS cx, count(DISTINCT domain) AS domains, count(*) FILTER (review_count > 0) AS k FROM map_items WHERE cluster >= 0 GROUP BY 1),
    c AS (SELECT cluster, min(id) AS first_central, count(*) AS centrals FROM map_items WHERE id IN (FROM cent) GROUP BY 1)
    SELECT CAST(s.cluster AS INTEGER) AS cluster_id, size, round(cx, 5) + 0.0 AS x, CAST(domains AS INTEGER) AS domains, CAST(centrals AS INTEGER) AS centrals, first_central, k AS coverage_count, 'feel' AS map_type FROM s JOIN c USING (cluster)""")
def k15(t):
    ids = F.transform("central_representatives", lambda e: e["id"])
    return records(t).select(
        "cluster_id", "size", (F.col("centroid.x") + F.lit(0.0)).alias("x"), F.size("domain_composition").alias("domains"), F.size("central_representatives").alias("centrals"),
        F.array_min(ids).alias("first_central"), "feel_profile.coverage_count", "map_type")


@query("k16_naming_prompts", """
    SELECT CAST(cluster AS INTEGER) AS cluster_id, true AS names_cluster, true AS asks_for_feeling FROM (SELECT DISTINCT cluster FROM map_items WHERE cluster >= 0)""")
def k16(t):
    p = naming.naming_prompts(records(t))
    return p.select("cluster_id", F.contains("prompt", F.format_string('"cluster_id":%d', "cluster_id")).alias("names_cluster"),
                    F.contains("prompt", F.lit("shared feeling")).alias("asks_for_feeling"))


@query("s14_prompt_export", """SELECT DISTINCT 'movies_music_restaurants_feel' AS map_id, CAST(cluster AS INTEGER) AS cluster_id, true AS names_cluster, true AS closed FROM map_items WHERE cluster >= 0""")
def s14(t):
    path = storage.scratch_folder(t.spark, "prompts")
    writers.write_prompts(records(t), path)
    back = t.spark.read.schema("map_id string, cluster_id int, prompt string").json(path)
    return back.select("map_id", "cluster_id", F.contains("prompt", F.format_string('"cluster_id":%d', "cluster_id")).alias("names_cluster"), F.rtrim("prompt").rlike(r"[.\}\]]$").alias("closed"))


@query("s15_versions", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def s15(t):
    base = storage.scratch_folder(t.spark, "versions")
    storage.publish(t.nation.where("n_regionkey < 3").select("n_nationkey", "n_name"), base, 1)
    storage.publish(storage.read_current(t.spark, base).withColumn("n_name", F.lower("n_name")), base, 2)
    storage.point_to(t.spark, base, 1)
    return storage.read_current(t.spark, base)


def review_counts(t):
    return t.orders_as_reviews.select(F.concat(F.lit("music:"), F.col("entity_id").cast("string")).alias("id"), "review_id")


@query("k13_item_profiles", f"""
    WITH f AS (SELECT id, review_count > 0 AS defined, {', '.join(f'({d} - avg({d}) FILTER (review_count > 0) OVER ()) / stddev_pop({d}) FILTER (review_count > 0) OVER () AS {d}' for d in FEEL_DIMENSIONS)} FROM map_items),
    o AS (SELECT concat('music:', o_custkey) AS id, count(*) AS n FROM orders GROUP BY 1)
    SELECT m.id, CASE WHEN defined THEN round(f.valence, 5) + 0.0 END AS valence, CASE WHEN defined THEN round(f.tenderness, 5) + 0.0 END AS tenderness,
      CASE WHEN r.entity_id IS NULL THEN 'base' ELSE 'base+review' END AS semantic_source, coalesce(o.n, 0) AS reviews_available,
      coalesce(r.review_count, 0) AS reviews_used, least(coalesce(o.n, 0), 5) AS reviews_sampled
    FROM map_items m JOIN f USING (id) LEFT JOIN review_vectors r ON r.entity_id = m.source_id LEFT JOIN o USING (id)""")
def k13(t):
    fused = fusion.fuse_modalities(t.embedding_table, t.review_vectors, 64)
    sources = fused.select("id", "has_base_semantics", "has_review_semantics", "semantic_source", "reviews_used_for_embedding")
    counts = review_counts(t).groupBy("id").agg(F.count(F.lit(1)).alias("available_count"))
    out = D.item_profiles(t.map_items, z_profiles(t), sources, counts)
    return out.select("id", (F.col("feel.valence") + F.lit(0.0)).alias("valence"), (F.col("feel.tenderness") + F.lit(0.0)).alias("tenderness"),
                      "semantic_source", "reviews_available", "reviews_used", "reviews_sampled")


@query("k14_review_samples", """
    SELECT o_custkey AS entity_id, count(*) AS available_count, least(count(*), 5) AS sampled_count,
      string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 5) AS picked FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat('42|', o_custkey, '|', o_orderkey)), o_orderkey) AS rn
      FROM orders) GROUP BY 1""")
def k14(t):
    s = D.review_samples(t.orders_as_reviews, "entity_id", ["review_id", "price"])
    ids = F.transform("reviews", lambda r: r["review_id"].cast("string"))
    return s.select("entity_id", "available_count", "sampled_count", F.array_join(ids, ",").alias("picked"))


@query("c09_item_details", f"""
    WITH d AS (SELECT domain, {FNV.format(c='source_id')} AS shard, source_id FROM map_items) SELECT domain, shard, count(*) AS items, min(source_id) AS first_id FROM d GROUP BY 1, 2""")
def c09(t):
    fused = fusion.fuse_modalities(t.embedding_table, t.review_vectors, 64)
    sources = fused.select("id", "has_base_semantics", "has_review_semantics", "semantic_source", "reviews_used_for_embedding")
    samples = D.review_samples(review_counts(t), "id", ["review_id"])
    details = D.item_profiles(t.map_items, z_profiles(t), sources, samples.select("id", "available_count"))
    full = details.join(samples.select("id", "reviews"), "id", "left")
    path = storage.scratch_folder(t.spark, "details")
    writers.write_shards(full, path)
    back, _ = writers.read_shards(t.spark, path, "source_id string")
    return back.groupBy("domain", "shard").agg(F.count(F.lit(1)).alias("items"), F.min("source_id").alias("first_id"))


@query("c10_naming_round", """
    SELECT id, CASE WHEN cluster < 0 THEN 'noise' ELSE concat('Region ', cluster) END AS cluster_label FROM map_items""")
def c10(t):
    """Records and requests out, names back in, checked and applied."""
    path = storage.scratch_folder(t.spark, "requests")
    writers.write_prompts(records(t), path)
    asked = t.spark.read.schema("map_id string, cluster_id int, prompt string").json(path).where("prompt <> ''")
    names = asked.select(F.col("cluster_id").alias("cluster"), F.format_string("Region %d", "cluster_id").alias("name"))
    items = t.map_items.withColumn("cluster_label", F.lit("noise"))
    return naming.apply_names(items, names).select("id", "cluster_label")


