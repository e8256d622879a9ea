"""Cluster descriptions for naming, and applying the names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.functions.constants import FEEL_DIMENSIONS, LABEL_STOPWORDS, NAMING_STOPWORDS
from mapwright.operators.feel import strongest_dimensions
from mapwright.operators.ranking import top_per_group


def centroids(items: DataFrame) -> DataFrame:
    return items.where("cluster >= 0").groupBy("cluster").agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("size"))


def with_centroid(items: DataFrame) -> DataFrame:
    """Items beside their cluster's centre. One centre row per cluster; the optimiser
    broadcasts the centres while they are small and shuffles otherwise."""
    return items.where("cluster >= 0").join(centroids(items), "cluster")


def centre_distance() -> Column:
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return dx * dx + dy * dy


def central_items(items: DataFrame, n: int = 15) -> DataFrame:
    near = with_centroid(items).withColumn("centre_distance", centre_distance())
    return top_per_group(near, ["cluster"], [F.col("centre_distance"), F.col("id")], n)


def popular_items(items: DataFrame, n: int = 5) -> DataFrame:
    order = [F.col("popularity").desc_nulls_last(), F.col("id")]
    return top_per_group(items.where("cluster >= 0"), ["cluster", "domain"], order, n)


def domain_composition(items: DataFrame) -> DataFrame:
    """Members and share per (cluster, domain)."""
    counts = items.where("cluster >= 0").groupBy("cluster", "domain").agg(F.count(F.lit(1)).alias("entity_count"))
    total = F.sum("entity_count").over(Window.partitionBy("cluster"))
    return counts.withColumn("share", F.round(F.col("entity_count") / total, 4))


def dominant_categories(items: DataFrame, categories: Column, n: int = 12) -> DataFrame:
    """Categories by how many members carry them."""
    members = items.where("cluster >= 0")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    counts = members.select("cluster", F.explode(F.array_distinct(categories)).alias("category")).groupBy(
        "cluster", "category").agg(F.count(F.lit(1)).alias("entity_count"))
    top = top_per_group(counts, ["cluster"], [F.col("entity_count").desc(), F.col("category")], n)
    return top.join(sizes, "cluster").withColumn(
        "share", F.round(F.col("entity_count") / F.col("size"), 4)).drop("size")


def representatives(items: DataFrame, central: int = 15, popular: int = 5) -> DataFrame:
    """Central and popular members, each once."""
    cols = items.columns
    return central_items(items, central).select(*cols).unionByName(
        popular_items(items, popular).select(*cols)).dropDuplicates(["id"])


def dominant_terms(items: DataFrame, text: str = "tags_text", n: int = 18) -> DataFrame:
    """Terms by the number of representatives using them."""
    terms = F.array_distinct(T.naming_tokens(T.text_or_empty(F.col(text)), NAMING_STOPWORDS))
    counts = representatives(items).select("cluster", F.explode(terms).alias("term")).groupBy(
        "cluster", "term").agg(F.count(F.lit(1)).alias("representative_count"))
    return top_per_group(counts, ["cluster"], [F.col("representative_count").desc(), F.col("term")], n)


def feel_profile(items: DataFrame, profiles: DataFrame, dims: Sequence[str] = FEEL_DIMENSIONS, prefix: str = "feel_z_", n: int = 7) -> DataFrame:
    """Mean z per dimension over the members that have one, coverage and strongest dimensions."""
    members = items.where("cluster >= 0").select("id", "cluster").join(
        profiles.select("id", F.lit(True).alias("_has"), *[prefix + d for d in dims]), "id", "left")
    means = members.groupBy("cluster").agg(
        F.count("_has").alias("coverage_count"),
        F.round(F.count("_has") / F.count(F.lit(1)), 4).alias("coverage_share"),
        *[F.round(F.avg(prefix + d), 4).alias(d) for d in dims])
    return means.withColumn("strongest", strongest_dimensions(dims, n, ""))


def common_labels(items: DataFrame) -> DataFrame:
    """Most common label of each cluster, ties by label."""
    counts = items.where("cluster >= 0 AND cluster_label IS NOT NULL").groupBy("cluster", "cluster_label").count()
    return counts.groupBy("cluster").agg(
        F.min(F.struct(-F.col("count"), "cluster_label"))["cluster_label"].alias("cluster_label"))


def top_words_label(items: DataFrame, text: str) -> DataFrame:
    """Two most frequent meaningful words per cluster joined by a slash."""
    words = items.select("cluster", F.explode(T.label_words(F.col(text))).alias("word"))
    return _top_two(words.where((F.length("word") >= 3) & ~F.col("word").isin(LABEL_STOPWORDS)))


def top_values_label(items: DataFrame, column: str) -> DataFrame:
    value = F.trim(F.col(column).cast("string"))
    return _top_two(items.select("cluster", value.alias("word")).where("word <> ''"))


def _top_two(words: DataFrame) -> DataFrame:
    counts = words.groupBy("cluster", "word").count()
    top = top_per_group(counts, ["cluster"], [F.col("count").desc(), F.col("word")], 2)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda r: r["word"])
    return top.groupBy("cluster").agg(F.array_join(ordered, " / ").alias("label"))


def region_labels(items: DataFrame) -> DataFrame:
    """Label per cluster: macro category, else the words of the first usable text."""
    labels = items.select("cluster").where("cluster IS NOT NULL").distinct()
    picked = F.lit(None).cast("string")
    for column in ("macro_genre", "semantic_text", "genres", "categories", "tags_text"):
        if column not in items.columns:
            continue
        build = top_values_label if column == "macro_genre" else top_words_label
        labels = labels.join(build(items, column).withColumnRenamed("label", f"_{column}"), "cluster", "left")
        picked = F.coalesce(picked, f"_{column}")
    return labels.select("cluster", F.coalesce(picked, F.lit("Unknown")).alias("cluster_label"))


def name_coverage(items: DataFrame, names: DataFrame) -> DataFrame:
    """Contract check, must be empty before names are applied: missing and surplus clusters."""
    clusters = items.where("cluster >= 0").select("cluster").distinct()
    missing = clusters.join(names, "cluster", "left_anti").select("cluster", F.lit("missing").alias("problem"))
    extra = names.join(clusters, "cluster", "left_anti").select("cluster", F.lit("extra").alias("problem"))
    return missing.unionByName(extra)


def name_problems(names: DataFrame) -> DataFrame:
    """Blank names, and names given to more than one cluster whatever their case."""
    clean = names.withColumn("key", F.lower(F.trim("name")))
    blank = clean.where("key IS NULL OR key = ''").select(F.lit("blank").alias("problem"), F.col("key"), F.lit(1).cast("bigint").alias("clusters"))
    twice = clean.where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("clusters")).where("clusters > 1")
    return blank.unionByName(twice.select(F.lit("duplicate").alias("problem"), "key", "clusters"))


def apply_names(items: DataFrame, names: DataFrame) -> DataFrame:
    """Put the names on their clusters; noise keeps its label.

    Clusters without a name, names without a cluster, blank names and names given twice are errors.
    """
    wrong = name_coverage(items, names).select(F.concat_ws(" ", "problem", "cluster").alias("what")).unionByName(
        name_problems(names).select(F.concat_ws(" ", "problem", "key").alias("what"))).first()
    if wrong is not None:
        raise ValueError(f"names do not fit the map: {wrong['what']}")
    joined = items.join(names.select("cluster", "name"), "cluster", "left")
    named = F.when(F.col("cluster") >= 0, F.col("name")).otherwise(F.col("cluster_label"))
    return joined.withColumn("cluster_label", named).drop("name").select(*items.columns)


def map_type(map_id: str) -> str:
    if map_id.endswith("_feel"):
        return "feel"
    return "mono" if map_id in ("movies", "music", "restaurants") else "general_cross_domain"


def naming_records(map_id: str, items: DataFrame, profiles: DataFrame, categories: Column) -> DataFrame:
    """One nested record per cluster; every list in it is already bounded by a top-n."""
    def node(df):
        return F.struct("id", "source_id", "title", "domain", "popularity")

    def gather(df, keys, entry, order, name):
        rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), entry.alias("e"))))
        return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["e"]).alias(name))

    central = central_items(items)
    popular = popular_items(items)
    by_domain = gather(popular, ["cluster", "domain"], node(popular), "rank", "items")
    feel = feel_profile(items, profiles)
    out = centroids(items).select(
        "cluster", "size", F.struct(F.round("cx", 5).alias("x"), F.round("cy", 5).alias("y")).alias("centroid"))
    parts = [
        gather(domain_composition(items), ["cluster"], F.struct("domain", "entity_count", "share"), "domain", "domain_composition"),
        gather(central, ["cluster"], node(central), "rank", "central_representatives"),
        gather(by_domain, ["cluster"], F.struct("domain", "items"), "domain", "popular_representatives"),
        gather(dominant_categories(items, categories), ["cluster"], F.struct("category", "entity_count", "share"), "rank", "dominant_categories"),
        gather(dominant_terms(items), ["cluster"], F.struct("term", "representative_count"), "rank", "dominant_semantic_terms"),
        feel.select("cluster", F.struct(
            "coverage_count", "coverage_share", F.struct(*FEEL_DIMENSIONS).alias("mean"),
            F.col("strongest").alias("strongest_dimensions")).alias("feel_profile")),
        common_labels(items).withColumnRenamed("cluster_label", "existing_label"),
    ]
    for part in parts:
        out = out.join(part, "cluster", "left")
    return out.select(
        F.lit(map_id).alias("map_id"), F.lit(map_type(map_id)).alias("map_type"), F.col("cluster").alias("cluster_id"),
        *[c for c in out.columns if c != "cluster"])


# Own wording: what a naming request says for each kind of map.
REQUESTS = {
    "mono": "The map covers one domain; its own genres and terms may appear in the name when they set the region apart.",
    "feel": "The map was laid out by experience, not by genre; name the shared feeling and leave genre labels out.",
    "general_cross_domain": "The map mixes domains; choose a theme that fits every domain in the region.",
}
COMMON_REQUEST = (
    "Name this region of a map of cultural works in two to six specific words and describe it in one sentence. "
    "Do not repeat the existing label and do not use words such as mixed or various.")


def naming_prompts(records: DataFrame) -> DataFrame:
    """One request text per cluster from the record and the kind of map."""
    kind = F.lit(None).cast("string")
    for name, text in REQUESTS.items():
        kind = F.when(F.col("map_type") == name, text).otherwise(kind)
    answer = F.format_string('Answer with JSON only: {"cluster_id": %d, "name": "...", "description": "..."}', "cluster_id")
    prompt = F.concat_ws("\n\n", F.lit(COMMON_REQUEST), kind, F.to_json(F.struct("*")), answer)
    return records.select("map_id", "cluster_id", prompt.alias("prompt"))
