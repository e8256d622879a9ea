"""The cluster tree against a brute-force build, and shapes of different density."""

import numpy as np
import pytest

from mapwright.operators.density_tree import density_tree_clusters

SCHEMA = "id string, x double, y double, kind string"


def shape(n, seed=0):
    """A dense blob, a blob eight times as wide, and thin noise."""
    rng = np.random.default_rng(seed)
    dense = rng.normal([0, 0], 0.25, (int(n * 0.45), 2))
    wide = rng.normal([9, 2], 2.0, (int(n * 0.45), 2))
    noise = rng.uniform(-30, 40, (n - len(dense) - len(wide), 2))
    points = np.concatenate([dense, wide, noise])
    kind = ["dense"] * len(dense) + ["wide"] * len(wide) + ["noise"] * len(noise)
    return [(f"i{k:06d}", float(x), float(y), t) for k, ((x, y), t) in enumerate(zip(points, kind, strict=True))]


def brute(rows, size, k, levels, allow_single=False):
    """Clusters as sets of row numbers: groups of every level by flood fill over points, then the best cut by recursion."""
    xy = np.array([r[1:3] for r in rows])
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    core = d[np.arange(len(d)), near[:, -1]]
    heights = np.unique(np.quantile(core, [(i + 1) / levels for i in range(levels)]))
    linked = np.zeros(d.shape, bool)
    linked[np.repeat(np.arange(len(d)), k), near.ravel()] = True
    linked |= linked.T
    floor = heights[heights > 0][0] / 2 if (heights > 0).any() else 1.0
    rate = 1 / np.maximum(heights, floor)

    def groups(level, among):
        left, out = {i for i in among if core[i] <= heights[level]}, []
        while left:
            todo = [left.pop()]
            group = set(todo)
            while todo:
                step = [j for j in np.nonzero(linked[todo.pop()])[0] if j in left]
                left.difference_update(step), group.update(step), todo.extend(step)
            if len(group) >= size:
                out.append(group)
        return out

    def best(level, group):
        """Stability and clusters of the branch whose widest group this is."""
        widest, own = group, 0.0
        while True:
            own += len(group) * (rate[level] - rate[level + 1] if level + 1 < len(rate) else 0.0)
            parts = groups(level - 1, group) if level else []
            if len(parts) != 1:
                break
            level, group = level - 1, parts[0]
        below = [best(level - 1, p) for p in parts]
        sub = sum(b[0] for b in below)
        if (allow_single or len(widest) < len(rows)) and own >= sub:
            return own, [widest]
        return sub, [c for b in below for c in b[1]]

    return {frozenset(c) for g in groups(len(heights) - 1, range(len(rows))) for c in best(len(heights) - 1, g)[1]}


def found_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(int(r["id"][1:]))
    out.pop(-1, None)
    return out


@pytest.mark.parametrize(("seed", "n", "size", "k", "levels"), [(1, 500, 25, 6, 16), (2, 700, 12, 5, 32), (3, 300, 8, 4, 8)])
def test_tree_equals_brute_force(spark, seed, n, size, k, levels):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 30, (6, 2))
    at = centres[rng.integers(0, 6, n)] + rng.normal(0, 1, (n, 2)) * rng.choice([0.3, 1.0, 4.0], n)[:, None]
    rows = [(f"i{i:06d}", float(x), float(y), "") for i, (x, y) in enumerate(at)]
    found = found_sets(density_tree_clusters(spark.createDataFrame(rows, SCHEMA), size, k, levels))
    assert len(found) > 1
    assert {frozenset(s) for s in found.values()} == brute(rows, size, k, levels)
    sizes = [len(found[c]) for c in sorted(found)]
    assert sorted(found) == list(range(len(found))) and sizes == sorted(sizes, reverse=True)


def test_blobs_of_two_densities_beside_noise(spark):
    items = spark.createDataFrame(shape(3000), SCHEMA)
    found = density_tree_clusters(items, min_cluster_size=150, min_samples=20).groupBy("kind", "cluster").count().collect()
    main = {r["kind"]: r["cluster"] for r in found if r["count"] > 0.7 * sum(o["count"] for o in found if o["kind"] == r["kind"])}
    assert sorted(main) == ["dense", "noise", "wide"]
    assert main["noise"] == -1 and {main["dense"], main["wide"]} == {0, 1}
    assert {r["cluster"] for r in found} == {-1, 0, 1}


def test_odd_inputs(spark):
    rows = [("z1", None, 1.0, "n"), ("z2", float("nan"), 1.0, "n"), ("z3", float("inf"), 0.0, "n")]
    assert {r["cluster"] for r in density_tree_clusters(spark.createDataFrame(rows, SCHEMA), 5, 3).collect()} == {-1}
    assert density_tree_clusters(spark.createDataFrame([], SCHEMA), 5, 3).count() == 0
    # A third of all rows in one place, beside a small group in another: two clusters, no level of zero is lost.
    same = [(f"i{i:06d}", 0.0, 0.0, "s") for i in range(40)] + [(f"i{i:06d}", 5.0 + i % 4, float(i % 3), "o") for i in range(40, 60)]
    found = found_sets(density_tree_clusters(spark.createDataFrame(same + rows, SCHEMA), 10, 4))
    assert {frozenset(s) for s in found.values()} == {frozenset(range(40)), frozenset(range(40, 60))}


def test_one_group_is_a_cluster_only_when_allowed(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{i:06d}", float(x), float(y), "") for i, (x, y) in enumerate(rng.uniform(0, 1, (120, 2)))]
    items = spark.createDataFrame(rows, SCHEMA)
    assert {frozenset(s) for s in found_sets(density_tree_clusters(items, 50, 6, 8)).values()} == brute(rows, 50, 6, 8)
    allowed = found_sets(density_tree_clusters(items, 50, 6, 8, allow_single=True))
    assert {frozenset(s) for s in allowed.values()} == brute(rows, 50, 6, 8, allow_single=True)
    assert allowed
