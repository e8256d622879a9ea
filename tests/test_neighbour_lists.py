"""Lists of neighbours: one search a place, compact blocks of queries, and a second round only for queries near an edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_density_tree import SCHEMA, brute, found_sets

from mapwright.operators import density_tree, histogram, neighbors


def test_tree_searches_places_not_rows(spark, monkeypatch):
    """Rows that share a place were searched and linked one by one: the lists had a row for each of them and each neighbour."""
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [40, 5], [15, 60], [70, 70]])
    at = (centres[rng.integers(0, 4, 600)] + rng.normal(0, 1, (600, 2)) * rng.choice([1.0, 3.0], 600)[:, None]).round()
    at[:40] = [0, 1]  # more rows in one place than a list is long
    rows = [(f"i{i:06d}", float(x), float(y), "") for i, (x, y) in enumerate(at)]
    sizes, write = {}, density_tree.written

    def spy(df, name):
        out = write(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(density_tree, "written", spy)
    found = found_sets(density_tree.density_tree_clusters(spark.createDataFrame(rows, SCHEMA), 20, 6, 12))
    assert sizes["lists"] == len({r[1:3] for r in rows}) < 400
    assert {frozenset(s) for s in found.values()} == brute(rows, 20, 6, 12) and len(found) > 1


def test_rows_without_an_id_are_noise_and_nobodys_neighbours(spark):
    rows = [(f"i{i:06d}", float(i % 5) + 50 * (i > 30), float(i // 5 % 6), "") for i in range(61)]
    want = found_sets(density_tree.density_tree_clusters(spark.createDataFrame(rows, SCHEMA), 10, 4, 8))
    nameless = [(None, 1.0, 2.0, ""), (None, 1.0, 2.0, ""), (None, 51.5, 2.5, "")]
    out = density_tree.density_tree_clusters(spark.createDataFrame(rows + nameless, SCHEMA), 10, 4, 8)
    assert out.columns == ["id", "x", "y", "kind", "cluster"]
    assert [r.cluster for r in out.where("id IS NULL").collect()] == [-1] * 3
    assert found_sets(out.where("id IS NOT NULL")) == want and len(want) == 2


@pytest.mark.parametrize(("n", "m", "k", "digits"), [(500, 700, 5, 1), (300, 4, 7, 3), (130, 2000, 25, 6), (0, 10, 3, 1), (10, 0, 3, 1)])
def test_blocks_agree_with_all_pairs(n, m, k, digits):
    """Candidates outside a block's reach are left out, those at equal distance stay in the order of their ids."""
    rng = np.random.default_rng(n + m)
    q, r = rng.normal(size=(n, 2)).round(digits), rng.normal(size=(m, 2)).round(digits)
    rid = rng.permutation(np.arange(m) * 2)
    qid = rng.choice(np.arange(2 * max(n, m)), n, replace=False)
    if n > 100:
        q[:3], q[3], r[:2] = [[np.nan, 0.0], [0.0, np.nan], [np.inf, 0.0]], [30.0, -4.0], [[np.nan, 1.0], [np.inf, 1.0]]
    limit = np.where(rng.uniform(size=n) < 0.5, np.inf, 0.05)
    rows, cols, dist = neighbors._nearest(qid, q[:, 0], q[:, 1], rid, r[:, 0], r[:, 1], k, limit)
    got = [[] for _ in range(n)]
    for i, j, d in zip(rows, cols, dist, strict=True):
        got[i].append((d, rid[j]))
    for i in range(n):
        d2 = (q[i, 0] - r[:, 0]) ** 2 + (q[i, 1] - r[:, 1]) ** 2
        assert got[i] == sorted((d, j) for d, j in zip(d2, rid, strict=True) if np.isfinite(d) and d <= limit[i] and j != qid[i])[:k]


def test_only_queries_near_an_edge_meet_the_second_round(spark, monkeypatch):
    """Before, all neighbours of all queries went through the merge; ids may be whole numbers."""
    rng = np.random.default_rng(8)
    at = rng.uniform(0, 20, (3000, 2))
    q = spark.createDataFrame([(i, float(x), float(y), "all") for i, (x, y) in enumerate(at)], "qid long, qx double, qy double, part string")
    seen, write = {}, neighbors.written

    def spy(df, name):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(neighbors, "written", spy)
    out = neighbors.knn_lists(q, q.toDF("rid", "rx", "ry", "part"), 4, tile_rows=400).collect()
    assert seen["first"].count() == 3000 and 0 < seen["first"].where("away").count() < 1500
    d = ((at[:, None] - at[None]) ** 2).sum(axis=2) + np.diag(np.full(3000, np.inf))
    assert {(r.qid, *(n.rid for n in r.near)) for r in out} == {(i, *map(int, np.argsort(d[i])[:4])) for i in range(3000)}


def test_percentiles_of_rows_that_stand_for_many(spark):
    few = spark.createDataFrame([(1.0, 5), (2.5, 1), (7.0, 4), (None, 3)], "v double, n long")
    many = few.select("v", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    shares = [0.0, 0.3, 0.5, 0.55, 1.0]
    assert histogram.exact_percentiles(few, [], "v", shares, "n").first() == histogram.exact_percentiles(many, [], "v", shares).first()
