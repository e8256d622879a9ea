"""How well a map keeps neighbourhoods, mixes labels and stays meaningful."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.functions.constants import FUSION_WEIGHTS
from mapwright.functions.lists import jaccard
from mapwright.functions.values import sample_score
from mapwright.operators import blocked as BL
from mapwright.operators import clusters as C
from mapwright.operators.neighbors import knn_join
from mapwright.operators.ranking import places
from mapwright.operators.sampling import sample, sample_per_class


def projection_quality(points: DataFrame, limit: int = 3000, k: int = 15) -> DataFrame:
    """Trustworthiness and neighbour preservation of a layout, per sampled item.

    ``points``: id, source (vector) and map (vector); at most ``limit`` rows. Columns:
    id, n, k, penalty, overlap.
    """
    def kernel(asks: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({"id": [], "n": [], "k": [], "penalty": [], "overlap": []})
        n = len(refs)
        kk = max(1, min(k, (n - 1) // 2))
        own = pd.Index(refs["id"]).get_indexer(asks["id"])
        high = BL.order_without_self(BL.squared_distances(BL.matrix(asks["source"]), BL.matrix(refs["source"])), own)
        low = BL.order_without_self(BL.squared_distances(BL.matrix(asks["map"]), BL.matrix(refs["map"])), own)[:, :kk]
        rank = np.empty_like(high)
        rank[np.arange(len(high))[:, None], high] = np.arange(1, n + 1)[None, :]
        found = np.take_along_axis(rank, low, axis=1)
        return pd.DataFrame({
            "id": asks["id"].to_numpy(), "n": n, "k": kk, "penalty": np.maximum(found - kk, 0).sum(axis=1).astype("int64"),
            "overlap": (found <= kk).sum(axis=1) / kk})

    return BL.per_query_block(points.select("id", "source", "map"), limit, kernel, "id string, n bigint, k bigint, penalty bigint, overlap double")


def quality_scores(per_item: DataFrame) -> DataFrame:
    """One row: trustworthiness and mean neighbour preservation."""
    one = per_item.agg(F.sum("penalty").alias("p"), F.max("n").alias("n"), F.max("k").alias("k"), F.avg("overlap").alias("knn_preservation"))
    n, k = F.col("n"), F.col("k")
    trust = 1 - F.col("p") * 2.0 / (n * k * (2 * n - 3 * k - 1))
    return one.select("n", "k", trust.alias("trustworthiness"), "knn_preservation")


def silhouette(points: DataFrame, limit: int = 5000) -> DataFrame:
    """Silhouette per sampled item from ``id``, ``vector`` and ``label``."""
    def kernel(asks: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({"id": [], "label": [], "silhouette": []})
        d = np.sqrt(BL.squared_distances(BL.matrix(asks["vector"]), BL.matrix(refs["vector"])))
        labels, codes = np.unique(refs["label"].to_numpy(), return_inverse=True)
        sums = np.stack([d[:, codes == c].sum(axis=1) for c in range(len(labels))], axis=1)
        sizes = np.bincount(codes, minlength=len(labels))
        mine = np.searchsorted(labels, asks["label"].to_numpy())
        rows = np.arange(len(asks))
        a = sums[rows, mine] / np.maximum(sizes[mine] - 1, 1)
        other = sums / sizes[None, :]
        other[rows, mine] = np.inf
        b = other.min(axis=1)
        score = np.where(sizes[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        return pd.DataFrame({"id": asks["id"].to_numpy(), "label": asks["label"].to_numpy(), "silhouette": score})

    return BL.per_query_block(points.select("id", "vector", "label"), limit, kernel, "id string, label string, silhouette double")


def _mixing_from_pairs(pairs: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """Per query: majority label of its neighbours, local entropy, share of other labels."""
    own = labels.select(F.col("id").alias("qid"), F.col("label").alias("own"))
    near = labels.select(F.col("id").alias("rid"), "label")
    counts = pairs.join(near, "rid").groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("qid").agg(
        F.sum("n").alias("k"), F.sum(F.col("n") * F.ln("n")).alias("s"),
        F.min(F.struct((-F.col("n")).alias("o"), F.col("label").alias("label")))["label"].alias("vote"),
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_label"))
    same = F.coalesce(F.try_element_at("by_label", F.col("own")), F.lit(0))
    entropy = (F.ln("k") - F.col("s") / F.col("k")) / float(np.log(classes))
    return per.join(own, "qid").select(
        "qid", "own", "vote", entropy.alias("entropy"), (1 - same / F.col("k")).alias("cross_share"))


def label_mixing(items: DataFrame, label: Column, k: int = 15, max_reference: int | None = None, query_per_class: int | None = None, seed: int = 42) -> DataFrame:
    """One row on how strongly the labels separate on the map; nulls below two classes.

    Every labelled item is a candidate and a query. ``max_reference`` and ``query_per_class`` ask for samples instead;
    the row says how many items took part.
    """
    points = items.select("id", "x", "y", label.cast("string").alias("label")).where("label IS NOT NULL")
    classes = points.select("label").distinct().count()
    names = ["knn_accuracy", "knn_balanced_accuracy", "chance_accuracy", "local_entropy", "cross_label_neighbor_share"]
    if classes < 2:
        empty = [F.lit(None).cast("double").alias(n) for n in names]
        return points.agg(F.count(F.lit(1)).alias("reference_items"), F.lit(0).cast("bigint").alias("query_items")).select(
            *empty, "reference_items", "query_items")
    reference = points if max_reference is None else sample_per_class(points, "id", "label", max(2, max_reference // classes), seed)
    queries = reference if query_per_class is None else sample_per_class(reference, "id", "label", query_per_class, seed + 1)
    q = queries.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.lit("all").alias("part"))
    r = reference.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.lit("all").alias("part"))
    pairs = knn_join(q, r, k)
    per = _mixing_from_pairs(pairs, reference, classes)
    return _mixing_row(per, reference, classes)


def _mixing_row(per: DataFrame, reference: DataFrame, classes: int) -> DataFrame:
    hit = (F.col("vote") == F.col("own")).cast("double")
    by_class = per.groupBy("own").agg(
        F.avg(hit).alias("recall"), F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"), F.sum("entropy").alias("e"),
        F.sum("cross_share").alias("c"))
    out = by_class.agg(
        (F.sum("hits") / F.sum("n")).alias("knn_accuracy"), F.avg("recall").alias("knn_balanced_accuracy"),
        F.lit(1.0 / classes).alias("chance_accuracy"), (F.sum("e") / F.sum("n")).alias("local_entropy"),
        (F.sum("c") / F.sum("n")).alias("cross_label_neighbor_share"), F.sum("n").alias("query_items"))
    return out.withColumn("reference_items", reference.agg(F.count(F.lit(1))).scalar())


def source_space_mixing(items: DataFrame, vector: str, label: Column, max_reference: int, query_per_class: int, k: int = 15, seed: int = 42) -> DataFrame:
    """Label mixing among nearest neighbours in the space the map was made from.

    Works on samples of the sizes asked for, because it looks at all their pairs; the row says how many took part.
    """
    points = items.select("id", F.col(vector).cast("array<double>").alias("vector"), label.cast("string").alias("label")).where("label IS NOT NULL")
    classes = points.select("label").distinct().count()
    per_class = max(2, max_reference // max(classes, 1))
    reference = sample_per_class(points, "id", "label", per_class, seed)
    queries = sample_per_class(reference, "id", "label", query_per_class, seed + 1)

    def kernel(asks: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({"qid": [], "rid": []})
        own = pd.Index(refs["id"]).get_indexer(asks["id"])
        order = BL.order_without_self(BL.squared_distances(BL.matrix(asks["vector"]), BL.matrix(refs["vector"])), own)
        order = order[:, : min(k, len(refs) - 1)]
        ids = refs["id"].to_numpy()
        return pd.DataFrame({"qid": np.repeat(asks["id"].to_numpy(), order.shape[1]), "rid": ids[order.ravel()]})

    pairs = BL.per_query_block(reference, per_class * classes, kernel, "qid string, rid string", queries=queries)
    return _mixing_row(_mixing_from_pairs(pairs, reference, classes), reference, classes)


def random_pairs(items: DataFrame, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """Repeatable pairs of different items, one for each item; ``n`` keeps the first so many.

    All items in two independent hash orders are matched place by place; a pair of an
    item with itself moves on to the next place.
    """
    def ordered(s):
        scored = items.select(F.col(key).alias("id"), sample_score(s, F.col(key)).alias("score"))
        placed = places(scored, "score", "id")
        return placed if n is None else placed.where(F.col("place") <= n)

    left, right = ordered(seed), ordered(seed + 1)
    size = right.agg(F.count(F.lit(1))).scalar()
    first = left.join(right.select("place", F.col("id").alias("other")), "place")
    next_ = right.select(F.col("place").alias("next_place"), F.col("id").alias("next_id"))
    moved = first.withColumn("next_place", F.col("place") % size + 1).join(next_, "next_place")
    other = F.when(F.col("other") == F.col("id"), F.col("next_id")).otherwise(F.col("other"))
    return moved.select("id", other.alias("other")).where("id <> other")


def semantic_coherence(items: DataFrame, tokens: Column, macro: Column, k: int = 15, queries: int | None = None, pairs: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Neighbours against random pairs: shared tokens and equal macro labels.

    Returns the summary row and the per-query detail. Every item is a candidate and a query;
    ``queries`` and ``pairs`` ask for samples instead.
    """
    facts = items.select("id", "x", "y", tokens.alias("tokens"), macro.alias("macro"))
    facts = facts.where(F.size("tokens") > 0)
    q = facts if queries is None else sample(facts, "id", queries, seed)
    ask = q.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.lit("all").alias("part"))
    ref = facts.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.lit("all").alias("part"))
    near = knn_join(ask, ref, k)
    local = _scored(near.select(F.col("qid").alias("a"), F.col("rid").alias("b"), "distance"), facts)
    baseline = _scored(random_pairs(facts, "id", pairs, seed).select(
        F.col("id").alias("a"), F.col("other").alias("b"), F.lit(None).cast("double").alias("distance")), facts)
    detail = local.groupBy(F.col("a").alias("id")).agg(
        F.avg("jaccard").alias("mean_neighbor_jaccard"), F.count("jaccard").alias("valid_neighbor_comparisons"),
        F.avg("distance").alias("mean_2d_neighbor_distance"))
    here = local.agg(F.struct(F.avg("jaccard").alias("j"), F.avg("same").alias("s"), F.count_distinct("a").alias("q"))).scalar()
    there = baseline.agg(F.avg("jaccard").alias("random_jaccard"), F.avg("same").alias("random_macro"))
    summary = there.withColumn("l", here).select(
        F.col("l.q").alias("query_items"), F.col("l.j").alias("local_jaccard"), "random_jaccard",
        (F.col("l.j") - F.col("random_jaccard")).alias("gain"), (F.col("l.j") / F.col("random_jaccard")).alias("lift"),
        F.col("l.s").alias("local_macro"), "random_macro", (F.col("l.s") / F.col("random_macro")).alias("macro_lift"))
    covered = items.agg(F.count(F.lit(1))).scalar()
    known = facts.agg(F.count(F.lit(1))).scalar()
    return summary.withColumn("coverage", known / covered), detail


def _scored(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    left = facts.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), F.col("macro").alias("ma"))
    right = facts.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), F.col("macro").alias("mb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "distance", jaccard(F.col("ta"), F.col("tb")).alias("jaccard"), (F.col("ma") == F.col("mb")).cast("double").alias("same"))


def fusion_weight_sweep(points: DataFrame, limit: int = 3000, k: int = 15, weights: Sequence[float] = FUSION_WEIGHTS) -> DataFrame:
    """Per weight: mean similarity of the k best neighbours in each modality, and the
    harmonic mean of both moved to [0, 1]. ``points``: id, base, review unit vectors."""
    shares = list(weights)

    def kernel(asks: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({"id": [], "weight": [], "base_sim": [], "review_sim": []})
        own = pd.Index(refs["id"]).get_indexer(asks["id"])
        a = BL.matrix(asks["base"]) @ BL.matrix(refs["base"]).T
        b = BL.matrix(asks["review"]) @ BL.matrix(refs["review"]).T
        kk, out = min(k, len(refs) - 1), []
        for s in shares:
            best = BL.order_without_self(-((1 - s) * a + s * b), own)[:, :kk]
            out.append(pd.DataFrame({
                "id": asks["id"].to_numpy(), "weight": s, "base_sim": np.take_along_axis(a, best, 1).mean(axis=1),
                "review_sim": np.take_along_axis(b, best, 1).mean(axis=1)}))
        return pd.concat(out)

    per = BL.per_query_block(points.select("id", "base", "review"), limit, kernel, "id string, weight double, base_sim double, review_sim double")
    means = per.groupBy("weight").agg(F.avg("base_sim").alias("base_similarity"), F.avg("review_sim").alias("review_similarity"))
    x, y = (F.col("base_similarity") + 1) / 2, (F.col("review_similarity") + 1) / 2
    return means.withColumn("balance", F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(F.lit(0.0)))


def best_weight(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.min(F.struct((-F.col("balance")).alias("o"), "weight"))["weight"].alias("weight"), F.max("balance").alias("balance"))


def map_metrics(name: str, items: DataFrame, domains: list[str], k: int = 15) -> DataFrame:
    """One row of structure, mixing and composition figures for a map."""
    size = C.cluster_sizes(items)
    counts = items.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(1))
    entropy = C.normalised_entropy(counts, ["g"]).select("entropy")
    weighted = C.weighted_mix(C.domain_mix(items, domains))
    mixing = label_mixing(items, F.col("domain"), k)
    reviewed = label_mixing(items, (F.col("review_count") > 0).cast("string"), k)
    out = size.select(F.lit(name).alias("map"), "items", "clusters", "noise", "largest_share")
    out = out.withColumn("size_entropy", entropy.scalar()).withColumn("w", weighted.select(F.struct("*")).scalar())
    picked = F.struct("knn_accuracy", "local_entropy", "cross_label_neighbor_share")
    out = out.withColumn("m", mixing.select(picked).scalar()).withColumn("r", reviewed.select(picked).scalar())
    return out.select(
        "map", "items", "clusters", "noise", "largest_share", "size_entropy", "w.weighted_purity", "w.weighted_entropy",
        F.col("m.knn_accuracy").alias("domain_accuracy"), F.col("m.local_entropy").alias("domain_entropy"),
        F.col("m.cross_label_neighbor_share").alias("cross_domain_share"),
        F.col("r.knn_accuracy").alias("review_accuracy"), F.col("r.cross_label_neighbor_share").alias("cross_review_share"))


def compare_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], figures: Sequence[str]) -> DataFrame:
    """Two metric rows side by side with signed differences (b minus a)."""
    left = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in figures])
    right = b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in figures])
    joined = left.join(right, list(keys))
    return joined.select(*keys, *[c for f in figures for c in (
        F.col(f"a_{f}"), F.col(f"b_{f}"), (F.col(f"b_{f}") - F.col(f"a_{f}")).alias(f"diff_{f}"))])


def feature_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns a map was made from, recognised by their prefix."""
    found = [c for c in df.columns if c.startswith(prefix)]
    if not found:
        raise ValueError(f"no column starts with {prefix}")
    return found
