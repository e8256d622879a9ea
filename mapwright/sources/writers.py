"""Map documents and detail shards as JSON datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapwright.functions.values import shard_of
from mapwright.operators.export import as_json, item_struct, json_safe, regions, shard_sizes
from mapwright.operators.naming import naming_prompts
from mapwright.operators.ranking import top_per_group
from mapwright.sources.storage import spread

SHARDS = 256
#: Folder name of rows without a domain; it is read back as null.
NO_DOMAIN = "__HIVE_DEFAULT_PARTITION__"


def landmarks(items: DataFrame, n: int = 5) -> DataFrame:
    """Largest items of every cluster."""
    top = top_per_group(items, ["cluster"], [F.col("visual_size").desc(), F.col("id")], n)
    return top.select("cluster", "rank", "id", "title", "x", "y", "visual_size")


def write_bundle(items: DataFrame, path: str, map_id: str) -> None:
    """Items, landmarks, regions and one metadata row, each a JSON dataset of its own."""
    as_json(item_struct(items, map_id), "value").write.mode("errorifexists").text(f"{path}/items")
    as_json(landmarks(items), "value").write.mode("errorifexists").text(f"{path}/landmarks")
    as_json(regions(items), "value").write.mode("errorifexists").text(f"{path}/regions")
    facts = items.agg(F.count(F.lit(1)).alias("item_count"), F.count_distinct("cluster").alias("region_count"))
    as_json(facts.withColumn("map_id", F.lit(map_id)), "value").write.mode("errorifexists").text(f"{path}/metadata")


def write_shards(details: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One file a (domain, shard) under ``items``, empty shards too; a client finds an id's shard by hashing the id.

    A file is one JSON object, id to document, with a line for each of its braces and documents, ids in order. A null id
    counts as the empty one; rows that share an id all stay, each on its line. Files appear when the whole write is
    committed, so a lost task leaves none. ``index`` lists every shard of every domain with its number of documents.
    """
    domain = F.when(F.coalesce("domain", F.lit("")) == "", NO_DOMAIN).otherwise(F.col("domain"))
    named = details.withColumns({"domain": F.coalesce(domain, F.lit(NO_DOMAIN)), "source_id": F.coalesce("source_id", F.lit(""))})
    inner = [c for c in details.columns if c not in ("domain", "shard")]
    # A map's text without its braces is the id and its document, as JSON writes them.
    safe = json_safe(named.withColumn("shard", shard_of(F.col("source_id"), shards)))
    entry = F.to_json(F.create_map("source_id", F.struct(*[F.col(f"`{c}`") for c in inner])), {"ignoreNullFields": "false"})
    body = safe.select("domain", "shard", F.lit(1).alias("part"), F.col("source_id").alias("place"), F.substring(entry, F.lit(2), F.length(entry) - 2).alias("value"))
    braces = F.array(F.struct(F.lit(0).alias("part"), F.lit("{").alias("value")), F.struct(F.lit(2).alias("part"), F.lit("}").alias("value")))
    frame = named.select("domain").distinct().select("domain", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.explode(braces).alias("b"))
    lines = body.unionByName(frame.select("domain", "shard", "b.part", F.lit("").alias("place"), "b.value"))
    in_file = Window.partitionBy("domain", "shard").orderBy("part", "place")
    comma = F.when((F.col("part") == 1) & (F.col("n") > 2), ",").otherwise("")
    ordered = spread(lines, "domain", "shard").withColumn("n", F.row_number().over(in_file)).select("domain", "shard", F.concat(comma, "value").alias("value"))
    ordered.write.mode("errorifexists").partitionBy("domain", "shard").text(f"{path}/items")
    shard_sizes(named, "domain", "source_id", shards).write.mode("errorifexists").json(f"{path}/index")


def shard_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all shard files with their ``domain``, ``shard`` and ``file``."""
    lines = spark.read.schema("value string, domain string, shard int").text(f"{path}/items")
    return lines.withColumn("file", F.col("_metadata.file_path"))


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """Files and documents of every (domain, shard), counted in the folders."""
    held = F.count(F.when(~F.col("value").isin("{", "}"), 1))
    return shard_lines(spark, path).groupBy("domain", "shard").agg(F.count_distinct("file").alias("files"), held.alias("count"))


def read_shards(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The items as they lie in their shards, and the index."""
    lines = shard_lines(spark, path).where(~F.col("value").isin("{", "}"))
    entry = F.from_json(F.concat(F.lit("{"), F.ltrim("value", F.lit(",")), F.lit("}")), f"map<string, struct<{schema}>>")
    items = lines.select(F.map_values(entry)[0].alias("item"), "domain", "shard").select("item.*", "domain", "shard")
    return items, spark.read.schema("domain string, shard int, count bigint").json(f"{path}/index")


def manifest(details: DataFrame, fit: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row: shard count, items per domain (as a map), and the scaler."""
    counts = details.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "n")))))
    return fit.select(F.lit(shards).alias("shard_count"), counts.scalar().alias("domain_counts"), F.struct("*").alias("scaler"))


def write_prompts(records: DataFrame, path: str) -> None:
    """One JSON line per cluster with the request text."""
    as_json(naming_prompts(records), "value").write.mode("errorifexists").text(path)
