"""Exact nearest neighbours on the map, built from balanced tiles.

1. Points that share a place keep only their ``k + 1`` smallest ids as candidates: no
   query can ever use more of them, since ties go to the smaller id.
2. The plane of each candidate set is cut into strips by quantiles of x and each strip
   into cells by quantiles of y, so tiles hold about ``TILE_ROWS`` candidates however
   the points crowd. At most 1024 x 1024 tiles exist; their edges fit on the driver.
3. Every query starts in the tile whose rectangle of candidates is nearest. The k-th distance
   found there bounds the answer: a packed tree of the rectangles gives the other tiles within
   it. A query far from all candidates so visits the near edge of them, not whole strips.

Queries of a crowded tile are split into chunks, each with its own copy of the tile. Each query keeps its neighbours in
one list; only queries that reach into other tiles meet a second round, and bring back from there what is near enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.operators.ranking import top_per_group
from mapwright.sources.storage import spread, written

TILE_ROWS = 2000
MAX_CUTS = 1024
BLOCK = 64
_FOUND = "ask bigint, qid {id}, part string, qx double, qy double, tile bigint, kth double, away boolean, near array<struct<d2: double, rid: {id}>>"

class Tiling:
    """Strip and cell edges per candidate set."""

    def __init__(self, sets: dict[str, tuple[np.ndarray, list[np.ndarray]]]):
        self.sets, at = {}, 0
        for name, (x_edges, y_edges) in sets.items():
            sizes = np.array([len(e) for e in y_edges])
            begin = np.concatenate([[0], np.cumsum(sizes)])
            starts = at + begin[:-1] + np.arange(len(sizes))
            self.sets[name] = (x_edges, np.concatenate([*y_edges, [np.inf]]), begin, starts)
            at += int(sizes.sum()) + len(sizes)
        self.tiles = at

    def _cells(self, name: str, strip: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Place of each y among the edges of its strip, all rows searched together."""
        _, flat, begin, _ = self.sets[name]
        low, high = begin[strip].copy(), begin[strip + 1].copy()
        while np.any(low < high):
            mid = (low + high) // 2
            open_, right = low < high, flat[mid] <= y
            low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low - begin[strip]

    def tile_of(self, part: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Tile of each point; -1 where the candidate set does not exist."""
        out = np.full(len(part), -1, dtype="int64")
        for name, (x_edges, _, _, starts) in self.sets.items():
            rows = np.nonzero(part == name)[0]
            strip = np.searchsorted(x_edges, x[rows], side="right")
            out[rows] = starts[strip] + self._cells(name, strip, y[rows])
        return out

    def room(self, name: str, tile: int) -> tuple[float, float, float, float]:
        """The part of the plane that belongs to a tile: least and largest x, least and largest y."""
        x_edges, flat, begin, starts = self.sets[name]
        strip = int(np.searchsorted(starts, tile, side="right")) - 1
        xs = np.concatenate([[-np.inf], x_edges, [np.inf]])
        ys = np.concatenate([[-np.inf], flat[begin[strip] : begin[strip + 1]], [np.inf]])
        cell = tile - starts[strip]
        return xs[strip], xs[strip + 1], ys[cell], ys[cell + 1]


class Boxes:
    """Packed tree over the rectangles that the candidates of each tile fill.

    Tiles are numbered along strips, so ``FAN`` tiles in a row make a compact node, and so on upwards. A search starts at
    the root and opens only nodes whose rectangle lies within a row's radius; all rows go down together. Each tile also
    shows its outermost candidates in ``COMPASS`` directions: those of the tiles met shrink the radius before any visit.
    """

    FAN, COMPASS = 16, 8

    def __init__(self, rows: list[tuple]):
        """Rows: part, tile, least and largest x, least and largest y, candidates, outermost places."""
        self.sets, self.outer = {}, {}
        found = pd.DataFrame(rows, columns=["part", "tile", "x0", "x1", "y0", "y1", "n", "outer"]).sort_values(["part", "tile"])
        for name, group in found.groupby("part", sort=False):
            places = np.array([[tuple(p) for p in o] for o in group["outer"]], dtype=float)
            for c in range(1, self.COMPASS):  # a place that shows in several directions counts once
                places[(places[:, :c] == places[:, c : c + 1]).all(axis=2).any(axis=1), c] = np.inf
            self.outer[name] = places
            levels = [group[["x0", "x1", "y0", "y1", "n"]].to_numpy(dtype=float)]
            while len(levels[-1]) > self.FAN:
                at, low = np.arange(0, len(levels[-1]), self.FAN), levels[-1]
                levels.append(np.column_stack([
                    np.minimum.reduceat(low[:, 0], at), np.maximum.reduceat(low[:, 1], at),
                    np.minimum.reduceat(low[:, 2], at), np.maximum.reduceat(low[:, 3], at), np.add.reduceat(low[:, 4], at)]))
            self.sets[name] = (group["tile"].to_numpy(), levels)

    @staticmethod
    def gaps(box: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance from each point to its rectangle."""
        dx = np.maximum(np.maximum(box[:, 0] - x, x - box[:, 1]), 0)
        dy = np.maximum(np.maximum(box[:, 2] - y, y - box[:, 3]), 0)
        return np.hypot(dx, dy)

    def _reach(self, levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, wanted: int) -> np.ndarray:
        """A radius that holds ``wanted`` candidates for sure: by the far corners of nodes, nearest first."""
        top = next(v for v in levels if len(v) <= 256 or v is levels[-1])
        far = np.hypot(np.maximum(x[:, None] - top[:, 0], top[:, 1] - x[:, None]), np.maximum(y[:, None] - top[:, 2], top[:, 3] - y[:, None]))
        order = np.argsort(far, axis=1)
        enough = np.cumsum(top[order, 4], axis=1) >= wanted
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(top) - 1)
        return far[np.arange(len(x)), order[np.arange(len(x)), at]]

    def _shrunk(self, name: str, reach: np.ndarray, row: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray, wanted: int) -> np.ndarray:
        """The radius, or the distance of the ``wanted``-th nearest outermost place of the tiles met where that is less."""
        out = reach.copy()
        for a in range(0, len(reach), 512):
            first, last = np.searchsorted(row, [a, a + 512])
            mine, places = row[first:last], self.outer[name][node[first:last]]
            far = np.hypot(places[:, :, 0] - x[mine][:, None], places[:, :, 1] - y[mine][:, None]).ravel()
            owner = np.repeat(mine, self.COMPASS)
            order = np.lexsort((far, owner))
            at = np.searchsorted(owner[order], np.arange(a, min(a + 512, len(reach)))) + wanted - 1
            own = np.minimum(at, len(order) - 1)
            enough = (at < len(order)) & (owner[order][own] == np.arange(a, min(a + 512, len(reach)))) if len(order) else np.zeros(len(at), bool)
            some = np.nonzero(enough)[0]
            out[a + some] = np.minimum(out[a + some], far[order][own[some]] * (1 + 1e-9) + 1e-12)
        return out

    def within(self, part: np.ndarray, x: np.ndarray, y: np.ndarray, radius: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, tiles and distances of the tiles within each row's radius; a row without a radius gets one that holds
        ``wanted`` candidates."""
        rows_out, tiles_out, gaps_out = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for name, (tiles, levels) in self.sets.items():
            rows = np.nonzero(part == name)[0]
            reach = radius[rows].copy()
            open_ = ~np.isfinite(reach)
            reach[open_] = self._reach(levels, x[rows][open_], y[rows][open_], wanted)
            reach = reach * (1 + 1e-9) + 1e-12
            row, node = np.repeat(np.arange(len(rows)), len(levels[-1])), np.tile(np.arange(len(levels[-1])), len(rows))
            for depth in reversed(range(len(levels))):
                gap = self.gaps(levels[depth][node], x[rows[row]], y[rows[row]])
                keep = gap <= reach[row]
                row, node, gap = row[keep], node[keep], gap[keep]
                if depth:
                    row, node = _ranges(row, node * self.FAN, np.minimum(node * self.FAN + self.FAN, len(levels[depth - 1])) - 1)
            keep = gap <= self._shrunk(name, reach, row, node, x[rows], y[rows], wanted)[row]
            rows_out.append(rows[row[keep]])
            tiles_out.append(tiles[node[keep]])
            gaps_out.append(gap[keep])
        return np.concatenate(rows_out), np.concatenate(tiles_out), np.concatenate(gaps_out)

    def nearest(self, part: np.ndarray, x: np.ndarray, y: np.ndarray, wanted: int, home: np.ndarray | None = None) -> np.ndarray:
        """The nearest tile of each row, the lowest of equally near ones; -1 where the candidate set does not exist.

        ``home`` is the tile of the plane a row lies in. A row inside that tile's rectangle takes it without a search; the
        far corner of the rectangle bounds the search of the others.
        """
        out, radius = np.full(len(part), -1, dtype="int64"), np.full(len(part), np.inf)
        for name, (tiles, levels) in self.sets.items() if home is not None else ():
            rows = np.nonzero(part == name)[0]
            at = np.minimum(np.searchsorted(tiles, home[rows]), len(tiles) - 1)
            held, box = tiles[at] == home[rows], levels[0][at]
            inside = held & (self.gaps(box, x[rows], y[rows]) == 0)
            out[rows[inside]] = home[rows[inside]]
            far = np.hypot(np.maximum(x[rows] - box[:, 0], box[:, 1] - x[rows]), np.maximum(y[rows] - box[:, 2], box[:, 3] - y[rows]))
            radius[rows[held]] = far[held]
        left = np.nonzero(out < 0)[0]
        for start in range(0, len(left), 4096):
            mine = left[start : start + 4096]
            row, tile, gap = self.within(part[mine], x[mine], y[mine], radius[mine], wanted if home is None else 1)
            order = np.lexsort((tile, gap, row))
            row, first = np.unique(row[order], return_index=True)
            out[mine[row]] = tile[order][first]
        return out


def _ranges(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from first to last beside its row."""
    count = last - first + 1
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(rows, count), np.repeat(first, count) + at


def _even_edges(grid: list[float], parts: int) -> np.ndarray:
    """``parts - 1`` inner edges picked evenly from a fine quantile grid."""
    picks = [grid[min(len(grid) - 1, (i * len(grid)) // parts)] for i in range(1, parts)]
    return np.unique(np.array(picks, dtype=float))


def build_tiling(refs: DataFrame, tile_rows: int) -> Tiling:
    """Two small aggregations: quantiles of x per set, then of y per strip."""
    grid = ", ".join(f"{i / MAX_CUTS}D" for i in range(MAX_CUTS))
    per_set = refs.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(rx, array({grid}), 10000)").alias("q")).collect()
    x_edges, single = {}, True
    for row in per_set:
        strips = min(MAX_CUTS, int(np.ceil(np.sqrt(row["n"] / tile_rows))))
        x_edges[row["part"]] = _even_edges(row["q"], strips)
        single &= len(x_edges[row["part"]]) == 0
    if single and all(r["n"] <= 2 * tile_rows for r in per_set):
        return Tiling({p: (e, [np.array([])]) for p, e in x_edges.items()})

    @F.pandas_udf("int")
    def strip_of(part: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(part), dtype="int32")
        for name, edges in x_edges.items():
            rows = (part == name).to_numpy()
            out[rows] = np.searchsorted(edges, x.to_numpy()[rows], side="right")
        return pd.Series(out)

    per_strip = refs.withColumn("strip", strip_of("part", "rx")).groupBy("part", "strip").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(ry, array({grid}), 10000)").alias("q")).collect()
    cells = {p: [np.array([]) for _ in range(len(e) + 1)] for p, e in x_edges.items()}
    for row in per_strip:
        parts = min(MAX_CUTS, max(1, round(row["n"] / tile_rows)))
        cells[row["part"]][row["strip"]] = _even_edges(row["q"], parts)
    return Tiling({p: (x_edges[p], cells[p]) for p in x_edges})


def _compact(x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
    """Row numbers in an order in which ``block`` rows in a row lie close together: strips of x, each by y."""
    strips = int(np.ceil(np.sqrt(len(x) / block)))
    strip = np.empty(len(x), dtype=int)
    strip[np.argsort(x, kind="stable")] = np.arange(len(x)) * strips // max(len(x), 1)
    return np.lexsort((y, strip))


def _nearest(
    qid: np.ndarray, qx: np.ndarray, qy: np.ndarray, rid: np.ndarray, rx: np.ndarray, ry: np.ndarray, k: int, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k nearest candidates of each query within its ``limit`` (squared), own id left out, ties by id.

    Flat arrays by query, nearest first: row of the query, row of the candidate and squared distance. Queries go in compact
    blocks: a block looks only at candidates no farther from its rectangle than a distance that holds ``k + 1`` of them
    for each of its queries.
    """
    by_id = pd.Series(rid).sort_values(kind="stable").index.to_numpy()
    rx, ry = rx[by_id], ry[by_id]
    own_row = pd.Index(rid[by_id]).get_indexer(qid)
    finite = np.nonzero(np.isfinite(qx) & np.isfinite(qy))[0]
    order = finite[_compact(qx[finite], qy[finite], BLOCK)]
    parts = []
    for start in range(0, len(order), BLOCK):
        block = order[start : start + BLOCK]
        bx, by, most = qx[block], qy[block], limit[block]
        left, right, low, high = bx.min(), bx.max(), by.min(), by.max()
        reach = most.max()
        if len(rx) > k:
            far = np.maximum(rx - left, right - rx) ** 2 + np.maximum(ry - low, high - ry) ** 2
            reach = min(reach, np.partition(far, k)[k])  # a place that is not finite comes last
        gap = np.maximum(np.maximum(left - rx, rx - right), 0) ** 2 + np.maximum(np.maximum(low - ry, ry - high), 0) ** 2
        seen = np.nonzero(gap <= reach * (1 + 1e-9))[0]
        if not len(seen):
            continue
        dx = bx[:, None] - rx[seen]
        dy = by[:, None] - ry[seen]
        d2 = dx * dx + dy * dy
        own = own_row[block]
        at = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
        mine = np.nonzero(seen[at] == own)[0]
        d2[mine, at[mine]] = np.inf
        take = min(k, len(seen))
        most = np.minimum(most, np.partition(d2, take - 1, axis=1)[:, take - 1])
        rows, cols = np.nonzero((d2 <= most[:, None]) & np.isfinite(d2))
        dist = d2[rows, cols]
        sort = np.lexsort((cols, dist, rows))
        rows, cols, dist = rows[sort], cols[sort], dist[sort]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        parts.append((block[rows[keep]], by_id[seen[cols[keep]]], dist[keep]))
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    rows, cols, dist = (np.concatenate([p[i] for p in parts]) for i in range(3))
    sort = np.argsort(rows, kind="stable")
    return rows[sort], cols[sort], dist[sort]


def _search(queries: DataFrame, refs: DataFrame, k: int, chunk_rows: int, tiling: Broadcast) -> DataFrame:
    """Neighbours of each (query, tile) row among the candidates of that tile, no farther than its ``kth``.

    The new ``kth`` is the k-th distance; ``away`` says that it may reach beyond the tile.
    """
    sizes = queries.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))
    # One short row per tile and never more than MAX_CUTS^2 tiles per set: safe to broadcast,
    # so queries crowding into one tile are not shuffled before they are split.
    sizes = F.broadcast(sizes)
    q = queries.join(sizes, "tile").select(
        "tile", F.pmod(F.xxhash64("ask"), F.col("chunks")).cast("int").alias("chunk"),
        "ask", F.col("qid").alias("id"), "part", F.col("qx").alias("x"), F.col("qy").alias("y"), "kth")
    r = refs.join(sizes, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(None).cast("bigint").alias("ask"), F.col("rid").alias("id"), "part", F.col("rx").alias("x"), F.col("ry").alias("y"),
        F.lit(None).cast("double").alias("kth"))

    def kernel(group: pa.Table) -> pa.Table:
        asks, cand = group.filter(group["ask"].is_valid()), group.filter(group["ask"].is_null())
        ids = cand["id"].combine_chunks()
        x, y, kth = (asks[c].to_numpy() for c in ("x", "y", "kth"))
        rows, cols, d2 = _nearest(
            asks["id"].to_numpy(), x, y, ids.to_numpy(zero_copy_only=False), cand["x"].to_numpy(), cand["y"].to_numpy(), k, kth)
        ends = np.searchsorted(rows, np.arange(len(x) + 1))
        kth = np.full(len(x), np.inf)
        full = np.nonzero(np.diff(ends) == k)[0]
        kth[full] = d2[ends[full + 1] - 1]
        near = pa.StructArray.from_arrays([pa.array(d2), ids.take(pa.array(cols, pa.int64()))], ["d2", "rid"])
        away = np.zeros(0, bool)
        if len(x):
            x0, x1, y0, y1 = tiling.value.room(asks["part"][0].as_py(), asks["tile"][0].as_py())
            reach = np.sqrt(kth) * (1 + 1e-9) + 1e-12
            away = ~((x - reach > x0) & (x + reach < x1) & (y - reach > y0) & (y + reach < y1))
        return pa.table({
            "ask": asks["ask"], "qid": asks["id"], "part": asks["part"], "qx": asks["x"], "qy": asks["y"],
            "tile": asks["tile"], "kth": kth, "away": away,
            "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)})

    found = _FOUND.format(id=refs.schema["rid"].dataType.simpleString())
    return spread(q.unionByName(r), "tile", "chunk").groupBy("tile", "chunk").applyInArrow(kernel, found)


def knn_lists(queries: DataFrame, refs: DataFrame, k: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``k`` nearest candidates of each query of a part as one list: columns qid, part, near (d2, the squared distance, and rid).

    ``queries`` has qid, qx, qy, part; ``refs`` has rid, rx, ry, part. A query meets the
    candidates of its part only, and never itself. Ids are texts or whole numbers, alike on both sides.
    """
    tile_rows = max(tile_rows, 4 * k)
    narrow = refs.select("rid", "rx", "ry", "part")
    kept = top_per_group(narrow, ["part", "rx", "ry"], [F.col("rid")], k + 1).drop("rank")
    kept = written(kept, "candidates")
    tiling = build_tiling(kept, tile_rows)
    shared = refs.sparkSession.sparkContext.broadcast(tiling)

    @F.pandas_udf("bigint")
    def tile_of(part: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(shared.value.tile_of(part.to_numpy(), x.to_numpy(), y.to_numpy()))

    # Every column that Python computes is written before it is used: a filter on it, or a second reader, would compute it
    # again in a worker of its own.
    tiled = written(kept.withColumn("tile", tile_of("part", "rx", "ry")), "tiled")
    # A row a tile; there are at most MAX_CUTS^2 tiles a set.
    turns = [2 * np.pi * i / Boxes.COMPASS for i in range(Boxes.COMPASS)]
    outer = [F.max_by(F.struct("rx", "ry"), F.col("rx") * float(np.cos(t)) + F.col("ry") * float(np.sin(t))) for t in turns]
    filled = tiled.groupBy("part", "tile").agg(F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry"), F.count(F.lit(1)), F.array(*outer))
    boxes = refs.sparkSession.sparkContext.broadcast(Boxes([tuple(r) for r in filled.collect()]))

    @F.pandas_udf("bigint")
    def first_tile(part: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        rows = part.to_numpy(), x.to_numpy(), y.to_numpy()
        return pd.Series(boxes.value.nearest(*rows, k + 1, shared.value.tile_of(*rows)))

    # Spread first, as the input may lie in few files; both the sizes and the search read this stage.
    even = spread(queries.select("qid", "qx", "qy", "part"), "qid", "part", "qx", "qy")
    asked = even.withColumn("tile", first_tile("part", "qx", "qy")).withColumn("ask", F.monotonically_increasing_id())
    asked = written(asked, "asked").where("tile >= 0").withColumn("kth", F.lit(float("inf")))
    first = _search(asked, tiled, k, 2 * tile_rows, shared)
    if tiling.tiles == len(tiling.sets):
        return first.select("qid", "part", "near")
    # The second round and the merge read this stage: run it once.
    first = written(first, "first").withColumn("near", F.filter("near", lambda n: n["rid"].isNotNull()))

    def look_around(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start in range(0, len(f), 4096):
                g = f.iloc[start : start + 4096]
                rows, tile, _ = boxes.value.within(g["part"].to_numpy(), g["qx"].to_numpy(), g["qy"].to_numpy(), np.sqrt(g["kth"].to_numpy()), k + 1)
                other = tile != g["tile"].to_numpy()[rows]
                yield g.iloc[rows[other]].assign(tile=tile[other])

    # Only queries that may look into other tiles are merged, by the number each was given.
    further = first.where("away")
    asks = further.select("ask", "qid", "part", "qx", "qy", "tile", "kth")
    others = written(asks.mapInPandas(look_around, asks.schema), "others")
    more = _search(others, tiled, k, 2 * tile_rows, shared)
    more = more.select("ask", "qid", "part", F.filter("near", lambda n: n["rid"].isNotNull()).alias("near")).where(F.size("near") > 0)
    both = further.select("ask", "qid", "part", "near").unionByName(more).groupBy("ask").agg(
        F.first("qid").alias("qid"), F.first("part").alias("part"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return first.where("NOT away").select("qid", "part", "near").unionByName(both.drop("ask"))


def knn_join(queries: DataFrame, refs: DataFrame, k: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The lists of ``knn_lists``, a row per neighbour: columns qid, part, rid, distance, rank."""
    found = knn_lists(queries, refs, k, tile_rows).select("qid", "part", F.posexplode("near").alias("at", "n"))
    return found.select("qid", "part", "n.rid", F.sqrt("n.d2").alias("distance"), (F.col("at") + 1).alias("rank")).where("rid IS NOT NULL")


def nearest_items(items: DataFrame, k: int = 5, tile_rows: int = TILE_ROWS) -> DataFrame:
    """k nearest other items of every item."""
    q = items.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.lit("all").alias("part"))
    r = items.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.lit("all").alias("part"))
    return knn_join(q, r, k, tile_rows).drop("part")


def nearest_by_label(items: DataFrame, label: Column, k: int, relation: str = "any", tile_rows: int = TILE_ROWS) -> DataFrame:
    """k nearest items of every label value for every item.

    ``relation``: 'same' keeps the item's own label, 'other' all the different ones,
    'any' both. Columns: qid, part (the label searched), rid, distance, rank.
    """
    labelled = items.withColumn("_label", label)
    values = labelled.where("_label IS NOT NULL").select(F.col("_label").alias("part")).distinct()
    r = labelled.where("_label IS NOT NULL").select(
        F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("_label").alias("part"))
    q = labelled.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), "_label")
    if relation == "same":
        return knn_join(q.where("_label IS NOT NULL").withColumnRenamed("_label", "part"), r, k, tile_rows)
    # The result has rows for every item and label, so the items are put beside all labels.
    every = values.agg(F.sort_array(F.collect_set("part"))).scalar()
    q = q.withColumn("part", F.explode(every))
    if relation == "other":
        q = q.where("_label IS NULL OR part <> _label")
    return knn_join(q.drop("_label"), r, k, tile_rows)


def popularity_bands(items: DataFrame, value: str = "popularity") -> DataFrame:
    """Band of each item from its domain's 20th and 80th percentile."""
    from mapwright.operators.histogram import exact_percentiles

    known = items.where(F.col(value).isNotNull())
    facts = known.groupBy("domain").agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    cuts = exact_percentiles(items, ["domain"], value, [0.2, 0.8]).join(facts, "domain")
    v = F.col(value)
    usable = (F.col("_n") >= 5) & (F.col("_lo") < F.col("_hi")) & v.isNotNull()
    band = F.when(~F.coalesce(usable, F.lit(False)), "unknown").when(v >= F.col("p1"), "mainstream")
    band = band.when(v <= F.col("p0"), "niche").otherwise("middle")
    return items.join(cuts, "domain", "left").withColumn("band", band).drop("_n", "_lo", "_hi", "p0", "p1")


def neighbour_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of two neighbour lists per query; lists hold at most k ids."""
    left = a.groupBy("qid").agg(F.collect_set("rid").alias("a"))
    right = b.groupBy("qid").agg(F.collect_set("rid").alias("b"))
    both = left.join(right, "qid")
    return both.select("qid", (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))
