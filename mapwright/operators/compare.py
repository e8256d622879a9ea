"""Two layouts of the same items side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.operators.neighbors import nearest_by_label


def compare_methods(a: DataFrame, b: DataFrame, m: int) -> DataFrame:
    """Per (item, other domain): how far the ``m`` nearest agree between two layouts.

    Items are taken from both layouts by id; lists hold at most ``m`` ids.
    """
    left, right = _lists(a, m, "a"), _lists(b, m, "b")
    both = left.join(right, ["qid", "part"])
    shared = F.size(F.array_intersect("ids_a", "ids_b"))
    return both.select(
        "qid", "part", shared.alias("shared"), (shared / F.size(F.array_union("ids_a", "ids_b"))).alias("jaccard"),
        "mean_distance_a", "mean_distance_b")


def _lists(items: DataFrame, m: int, name: str) -> DataFrame:
    near = nearest_by_label(items, F.col("domain"), m, "other")
    return near.groupBy("qid", "part").agg(
        F.collect_set("rid").alias(f"ids_{name}"), F.avg("distance").alias(f"mean_distance_{name}"))
