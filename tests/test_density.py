"""Density clusters follow the shape of the map, not the number of its rows."""

import numpy as np
import pytest

from mapwright.operators.density import components, density_clusters


def shape(n, seed=0):
    """Two dense blobs, one long arm, thin noise and one far outlier."""
    rng = np.random.default_rng(seed)
    blob = rng.normal([0, 0], 0.5, (int(n * 0.45), 2))
    other = rng.normal([6, 5], 0.5, (int(n * 0.35), 2))
    arm = np.column_stack([rng.uniform(-4, 4, int(n * 0.15)), rng.normal(9, 0.1, int(n * 0.15))])
    noise = rng.uniform(-8, 12, (n - len(blob) - len(other) - len(arm) - 1, 2))
    points = np.concatenate([blob, other, arm, noise, [[900.0, -700.0]]])
    kind = ["a"] * len(blob) + ["b"] * len(other) + ["arm"] * len(arm) + ["noise"] * (len(noise) + 1)
    return [(f"i{k}", float(x), float(y), t) for k, ((x, y), t) in enumerate(zip(points, kind, strict=True))]


@pytest.mark.parametrize("n", [2000, 20000, 200000])
def test_same_shape_same_clusters(spark, n):
    items = spark.createDataFrame(shape(n), "id string, x double, y double, kind string")
    found = density_clusters(items, min_cluster_size=n // 40).groupBy("kind", "cluster").count().collect()
    main = {}
    for row in found:
        total = sum(r["count"] for r in found if r["kind"] == row["kind"])
        if row["count"] > 0.6 * total:
            main[row["kind"]] = row["cluster"]
    assert main == {"a": 0, "b": 1, "arm": 2, "noise": -1}
    assert {r["cluster"] for r in found} == {-1, 0, 1, 2}


def test_size_estimates_do_not_grow_by_the_round(spark):
    """A checkpointed round kept the estimate of the joins behind it: its digits doubled each round, up to the driver's memory."""
    path = spark.range(200).selectExpr("id AS cx", "id % 2 AS cy")
    found = components(path)
    assert found.select("label").distinct().count() == 1
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 300
