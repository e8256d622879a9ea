"""Cluster statistics of every item: popularity and centrality ranks, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.operators import naming as N
from mapwright.operators.neighbors import knn_join
from mapwright.operators.ranking import ascending_rank, descending_rank


def cluster_summary(items: DataFrame) -> DataFrame:
    """Size, centre, label and leading domain of every cluster; noise is left out."""
    comp = N.domain_composition(items)
    lead = comp.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("domains"),
        F.min(F.struct((-F.col("entity_count")).alias("o"), F.col("domain").alias("domain"), F.col("share").alias("share"))).alias("lead"))
    return N.centroids(items).join(N.common_labels(items), "cluster", "left").join(lead, "cluster").select(
        "cluster", "size", "cx", "cy", "cluster_label", "domains", F.col("lead.domain").alias("main_domain"),
        F.col("lead.share").alias("main_share"))


def popularity_rank(items: DataFrame) -> DataFrame:
    """Place of each item among its cluster's items of the same domain."""
    return descending_rank(items.where("cluster >= 0"), ["cluster", "domain"], "popularity", "popularity")


def centrality_rank(items: DataFrame) -> DataFrame:
    """Place of each item by distance to its cluster's centre."""
    far = N.with_centroid(items).withColumn("own_distance", F.sqrt(N.centre_distance()))
    return ascending_rank(far, ["cluster"], "own_distance", "centrality")


def competing_centres(items: DataFrame) -> DataFrame:
    """Distance to the nearest centre of another cluster.

    The two nearest centres of a point hold the answer: the nearest, or the second when
    the nearest is its own. Both come from the tiled neighbour search, so the number of
    clusters does not matter.
    """
    members = items.where("cluster >= 0")
    centres = N.centroids(items)
    q = members.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.lit("all").alias("part"))
    r = centres.select(F.format_string("%012d", "cluster").alias("rid"), F.col("cx").alias("rx"), F.col("cy").alias("ry"), F.lit("all").alias("part"))
    near = knn_join(q, r, 2).select(F.col("qid").alias("id"), F.col("rid").cast("int").alias("other"), "distance")
    pairs = near.join(members.select("id", "cluster"), "id").where("other <> cluster")
    return pairs.groupBy("id").agg(F.min(F.struct("distance", "other")).alias("m")).select(
        "id", F.col("m.other").alias("competing_cluster"), F.col("m.distance").alias("competing_distance"))


def boundary_score(own: Column, competing: Column) -> Column:
    """Share of the way to the competing centre; 0.5 when both distances are zero."""
    both = own + competing
    return F.when(competing.isNull(), None).when(both == 0, F.lit(0.5)).otherwise(competing / both)


def boundary_status(score: Column) -> Column:
    # Limits and wording of the boundary status.
    return (
        F.when(score.isNull(), "No competing region")
        .when(score < 0.5, "Closer to neighbouring region centre")
        .when(score < 0.55, "Very near region boundary")
        .when(score < 0.65, "Near region boundary")
        .when(score < 0.8, "Inside region")
        .otherwise("Far from competing region"))


def item_statistics(items: DataFrame) -> DataFrame:
    """The full record per clustered item."""
    central = centrality_rank(items).select(
        "id", "cluster", "domain", "own_distance", "centrality_rank", "centrality_top_percent", "size")
    popular = popularity_rank(items).select("id", "popularity_rank", "popularity_top_percent")
    out = central.join(popular, "id", "left").join(competing_centres(items), "id", "left")
    score = boundary_score(F.col("own_distance"), F.col("competing_distance"))
    return out.withColumn("boundary_score", score).withColumn("boundary_status", boundary_status(F.col("boundary_score")))


def cluster_sizes(items: DataFrame) -> DataFrame:
    """One row: clusters, noise, missing, largest cluster and its share of all items."""
    sizes = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("cluster") >= 0
    return sizes.agg(
        F.sum("n").alias("items"), F.count_if(real).alias("clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") < 0, F.col("n"))), F.lit(0)).alias("noise"),
        F.coalesce(F.sum(F.when(F.col("cluster").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.max(F.when(real, F.col("n"))).alias("largest")).withColumn("largest_share", F.col("largest") / F.col("items"))


def normalised_entropy(counts: DataFrame, groups: list[str], count: str = "n") -> DataFrame:
    """Entropy of counts over ln(number of groups); 0 when there is at most one."""
    positive = counts.where(F.col(count) > 0)
    n = F.col(count)
    # -sum(p ln p) = ln(total) - sum(n ln n) / total
    agg = positive.groupBy(*groups).agg(
        F.sum(n).alias("_t"), F.sum(n * F.ln(n)).alias("_s"), F.count(F.lit(1)).alias("_g"))
    value = (F.ln("_t") - F.col("_s") / F.col("_t")) / F.ln("_g")
    return agg.select(*groups, F.when(F.col("_g") > 1, value).otherwise(F.lit(0.0)).alias("entropy"))


def domain_mix(items: DataFrame, domains: list[str]) -> DataFrame:
    """Counts and shares per domain, purity and entropy of every cluster."""
    wide = items.where("cluster >= 0").groupBy("cluster").pivot("domain", domains).count().na.fill(0)
    total = sum((F.col(f"`{d}`") for d in domains), F.lit(0))
    shares = [F.col(f"`{d}`") / F.col("size") for d in domains]
    terms = [F.when(s > 0, -s * F.ln(s)).otherwise(F.lit(0.0)) for s in shares]
    entropy = sum(terms, F.lit(0.0)) / F.ln(F.lit(float(len(domains))))
    return wide.withColumn("size", total).select(
        "cluster", "size", *[F.col(f"`{d}`").alias(f"count_{d}") for d in domains],
        *[s.alias(f"share_{d}") for s, d in zip(shares, domains)], F.greatest(*shares).alias("purity"),
        entropy.alias("entropy"))


def weighted_mix(mix: DataFrame) -> DataFrame:
    w = F.sum("size")
    return mix.agg(
        (F.sum(F.col("size") * F.col("purity")) / w).alias("weighted_purity"),
        (F.sum(F.col("size") * F.col("entropy")) / w).alias("weighted_entropy"))
