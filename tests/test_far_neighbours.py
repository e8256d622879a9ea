"""Neighbours far from their candidates, and the tree of rectangles behind them."""

import numpy as np
import pytest

from mapwright.operators import neighbors


def boxes_of(part, tile, x, y):
    rows = []
    for name in np.unique(part):
        for t in np.unique(tile[part == name]):
            m = np.nonzero((tile == t) & (part == name))[0]
            turns = [2 * np.pi * i / neighbors.Boxes.COMPASS for i in range(neighbors.Boxes.COMPASS)]
            outer = [m[np.argmax(x[m] * np.cos(a) + y[m] * np.sin(a))] for a in turns]
            rows.append((name, int(t), x[m].min(), x[m].max(), y[m].min(), y[m].max(), len(m), [(x[j], y[j]) for j in outer]))
    return neighbors.Boxes(rows)


@pytest.mark.parametrize("shift", [0.0, 3.0, 25.0])
def test_tiles_within_reach_hold_the_neighbours(shift):
    """Two domains far apart: the tiles a query opens are few, and no nearer candidate lies in any other."""
    rng = np.random.default_rng(1)
    n, side, k = 40_000, 20, 5
    x, y = rng.normal(size=n), rng.normal(size=n)
    strip = np.argsort(np.argsort(x)) * side // n
    tile = np.empty(n, dtype=int)
    for s in range(side):
        rows = np.nonzero(strip == s)[0]
        tile[rows] = s * side + np.argsort(np.argsort(y[rows])) * side // len(rows)
    boxes = boxes_of(np.full(n, "a"), tile, x, y)
    qx, qy, part = rng.normal(size=200) + shift, rng.normal(size=200) + shift / 3, np.full(200, "a")
    first = boxes.nearest(part, qx, qy, k + 1)
    kth, want = np.empty(200), []
    for i in range(200):
        far = np.hypot(x - qx[i], y - qy[i])
        kth[i] = np.sort(far[tile == first[i]])[k - 1]
        want.append(set(tile[np.argsort(far)[:k]]))
    row, found, _ = boxes.within(part, qx, qy, kth, k + 1)
    assert all(want[i] <= set(found[row == i]) for i in range(200))
    everywhere, _, _ = boxes.within(part, qx, qy, np.full(200, np.inf), k + 1)
    assert len(row) / 200 < 8 and len(everywhere) / 200 < 40
    assert (boxes.nearest(np.full(2, "b"), qx[:2], qy[:2], 1) == -1).all()


def test_far_domains_agree_with_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{d}{i}", d, float(a + 40 * (d == "n")), float(b)) for d in "mn" for i, (a, b) in enumerate(rng.normal(size=(700, 2)).round(1))]
    items = spark.createDataFrame(rows, "id string, domain string, x double, y double")
    found = neighbors.nearest_by_label(items, items.domain, 3, relation="other", tile_rows=20).collect()
    got = {}
    for r in found:
        got.setdefault(r.qid, []).append((r.rank, r.rid))
    for i, d, x, y in rows[::50]:
        others = sorted((round((a - x) ** 2 + (b - y) ** 2, 9), j) for j, e, a, b in rows if e != d)[:3]
        assert [r for _, r in sorted(got[i])] == [j for _, j in others]


def test_rows_inside_their_own_rectangle_need_no_search(monkeypatch):
    """Choosing a first tile searched the tree for every row; the tile a row lies in answers most of them."""
    rng = np.random.default_rng(3)
    x, y = rng.uniform(size=4000), rng.uniform(size=4000)
    tile, part = (x * 8).astype(int) * 8 + (y * 8).astype(int), np.full(4000, "a")
    boxes = boxes_of(part, tile, x, y)
    searched = []
    within = neighbors.Boxes.within
    monkeypatch.setattr(neighbors.Boxes, "within", lambda self, p, a, b, r, n: searched.append(len(p)) or within(self, p, a, b, r, n))
    assert (boxes.nearest(part, x, y, 6, tile) == tile).all() and not searched
    qx, qy = rng.uniform(-3, 4, 500), rng.uniform(-3, 4, 500)
    home = np.clip(qx * 8, 0, 7).astype(int) * 8 + np.clip(qy * 8, 0, 7).astype(int)
    found = boxes.nearest(np.full(500, "a"), qx, qy, 6, home)
    tiles, levels = boxes.sets["a"]
    gaps = np.stack([boxes.gaps(np.repeat(levels[0][[t]], 500, axis=0), qx, qy) for t in range(len(tiles))])
    assert np.allclose(gaps[np.searchsorted(tiles, found), np.arange(500)], gaps.min(axis=0))
    assert (boxes.nearest(np.array(["b"]), qx[:1], qy[:1], 6, home[:1]) == -1).all()
