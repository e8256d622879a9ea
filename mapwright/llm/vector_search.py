"""Approximate nearest neighbours by inner product: balanced posting lists behind an in-memory graph of centroids.

1. A bounded sample is cut in halves of equal size again and again; the means of the pieces are the centroids of the lists.
   One more coordinate gives every vector the length of the longest one, so that the largest inner product is the least
   distance; queries get that length by scaling and a zero there.
2. Every row goes to the list of its nearest centroid, and rows near a boundary to more lists (``COPIES`` on average). Both
   searches, of rows and of queries, walk a graph that joins each centroid with its nearest ones, in numpy inside the task.
3. A query visits the lists whose centroid is at most ``ratio`` times as far as the nearest one. The ratio is fitted on the
   sample, so that ``RECALL`` of the exact neighbours there lie in a visited list. A query whose lists hold too few rows
   goes on to the next nearest lists until they hold enough. What the query finds among the sample's rows of its lists is a
   first bound: rows of other parts that score less are in no answer.
4. Neighbouring lists form parts of about ``PART_ROWS`` rows, larger lists are dealt over several parts; a query is sent once
   to each part it visits. The best rows of all parts meet per query.

All rows are indexed. Equal vectors have equal scores, so only the smallest ``k + 1`` ids of a vector can be in any answer:
tasks keep no more of them, and equal queries are asked once; a vector that a third of the rows share costs little.
Scores are inner products in double precision of the vectors as they are.

Rows without an id and vectors that are null, empty, zero, hold null or non-finite numbers, or have another length than most
(of equally frequent lengths the smaller one counts) take no part. Rows with the same id and vector count once; a query's own
row is the one with its id and its vector. Rows that share the id but not the vector are queries and candidates of their own.
Equal scores go by the smaller id. An empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapwright.llm.common import stored
from mapwright.sources.storage import spread

#: Rows of a list at first, and the most lists; beyond that lists grow and are dealt over more parts.
LIST_ROWS, MAX_LISTS = 64, 16_384
#: Sample that fits the centroids: at least so many rows a list, in all at most so many bytes.
SAMPLE_PER_LIST, SAMPLE_BYTES = 8, 32 << 20
#: Lists a row is in: on average, and at most.
COPIES, MOST_COPIES = 1.5, 4
#: Share of the sample's exact neighbours that the visited lists must hold; queries of the sample that are asked.
RECALL, ASKED = 0.97, 512
#: Rows of the sample that give a query its first bound.
BOUND_ROWS = 16_384
#: Edges of a centroid in the graph, first centroids of a walk, and how much farther than the nearest one a walk looks at least.
EDGES, ENTRIES, LOOK = 16, 128, 1.1
PART_ROWS, QUERY_ROWS = 4096, 512
#: Rows more than asked for that are scored again one by one.
SPARE = 8


class Model(NamedTuple):
    centers: np.ndarray
    edges: np.ndarray
    entries: np.ndarray
    longest: float
    near: float  # a row goes to lists up to so many times the least distance
    ratio: float  # a query, to lists up to so many times it
    least: float  # distances below count as this one
    rows: np.ndarray  # of the sample, at most BOUND_ROWS
    lists: np.ndarray  # the nearest list of each


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))
    return np.hstack([x, rest[:, None]])


def as_queries(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x * (longest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def pieces(x: np.ndarray, n: int) -> list[np.ndarray]:
    """The rows in ``n`` pieces of equal size (up to one row), each cut between its two centres."""
    out, todo = [], [(np.arange(len(x)), n)]
    while todo:
        rows, n = todo.pop()
        if n == 1:
            out.append(rows)
            continue
        y, cut = x[rows], len(rows) * (n // 2) // n
        far = y - y.mean(axis=0)
        ends = [int(np.argmax(np.einsum("ij,ij->i", far, far)))]
        ends.append(int(np.argmin(far @ far[ends[0]])))
        low, high = y[ends[0]], y[ends[1]]
        for _ in range(5):
            order = np.argsort(y @ (high - low), kind="stable")
            low, high = y[order[:cut]].mean(axis=0), y[order[cut:]].mean(axis=0)
        todo += [(rows[order[cut:]], n - n // 2), (rows[order[:cut]], n // 2)]
    return out


def fit(sample: np.ndarray, total: int, longest: float, k: int) -> Model:
    """Centroids, graph and both ratios from distinct vectors (doubles)."""
    lists = max(1, min(MAX_LISTS, -(-total // LIST_ROWS), len(sample) // SAMPLE_PER_LIST))
    x = lifted(sample, longest)
    centers = np.stack([x[rows].mean(axis=0) for rows in pieces(x, lists)])
    edges = np.empty((lists, min(EDGES, lists)), dtype=np.int32)
    for a in range(0, lists, 512):
        edges[a : a + 512] = np.argsort(distances(centers[a : a + 512], centers), axis=1, kind="stable")[:, : edges.shape[1]]
    entries = np.unique(np.linspace(0, lists - 1, min(ENTRIES, lists)).astype(np.int64))
    most = min(MOST_COPIES, lists)
    nearest, far = np.empty((len(x), most), dtype=np.int64), np.empty((len(x), most))
    for a in range(0, len(x), 2048):
        d = distances(x[a : a + 2048], centers)
        nearest[a : a + 2048] = np.argsort(d, axis=1, kind="stable")[:, :most]
        far[a : a + 2048] = np.take_along_axis(d, nearest[a : a + 2048], axis=1)
    times = far[:, 1:] / np.maximum(far[:, :1], 1e-300)
    room = int((COPIES - 1) * len(x))
    near = float(np.partition(times.ravel(), room)[room]) if room < times.size else np.inf
    held = np.hstack([np.ones((len(x), 1), dtype=bool), times < near])
    asked = np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(np.int64)
    d = distances(as_queries(sample[asked], longest), centers)
    least = float(np.median(d.min(axis=1)))
    need = []
    for r, q in enumerate(asked):
        score = sample @ sample[q]
        score[q] = -np.inf
        top = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        need.append(np.where(held[top], d[r][nearest[top]], np.inf).min(axis=1) / max(d[r].min(), least, 1e-300))
    need = np.concatenate(need) if len(x) > 1 else np.ones(1)
    some = np.linspace(0, len(x) - 1, min(BOUND_ROWS, len(x))).astype(np.int64)
    return Model(centers, edges, entries, longest, near, float(np.quantile(need, RECALL, method="higher")), least, sample[some], nearest[some, 0])


def walk(model: Model, x: np.ndarray, times: float, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, list and distance of the lists within ``times`` the least distance, nearest first per row; ``least`` is a floor of it.

    Every centroid within reach is expanded once. The reach only shrinks, so what is beyond it stays out.
    """
    n, lists = len(x), len(model.centers)
    length, lengths = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", model.centers, model.centers)
    seen = np.zeros(n * lists, dtype=bool)
    best = np.full(n, np.inf)
    row, at = np.repeat(np.arange(n), len(model.entries)), np.tile(model.entries, n)
    found = []
    while len(row):
        seen[row * lists + at] = True
        far = np.empty(len(row))
        for a in range(0, len(row), 1 << 15):
            r, c = row[a : a + (1 << 15)], at[a : a + (1 << 15)]
            far[a : a + (1 << 15)] = np.sqrt(np.maximum(length[r] + lengths[c] - 2 * np.einsum("ij,ij->i", x[r], model.centers[c]), 0))
        np.minimum.at(best, row, far)
        keep = far <= times * np.maximum(best, least)[row]
        row, at = row[keep], at[keep]
        found.append((row, at, far[keep]))
        flat = (row[:, None] * lists + model.edges[at]).ravel()
        flat = np.unique(flat[~seen[flat]])
        row, at = flat // lists, flat % lists
    row, at, far = (np.concatenate([f[i] for f in found]) for i in range(3))
    keep = far <= times * np.maximum(best, least)[row]
    row, at, far = row[keep], at[keep], far[keep]
    order = np.lexsort((at, far, row))
    return row[order], at[order], far[order]


def blocks_of(n: int, lists: int) -> Iterator[slice]:
    size = max(1, min(4096, (1 << 22) // lists))
    return (slice(a, a + size) for a in range(0, n, size))


def assign(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and the lists they go to; the last array tells the first list of each row."""
    rows, lists, firsts = [], [], []
    for part in blocks_of(len(x), len(model.centers)):
        row, at, far = walk(model, lifted(x[part], model.longest), max(LOOK, min(model.near, 2.0)))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (place == 0) | ((place < MOST_COPIES) & (far < model.near * far[np.searchsorted(row, row)]))
        rows.append(row[keep] + part.start)
        lists.append(at[keep])
        firsts.append(place[keep] == 0)
    return np.concatenate(rows), np.concatenate(lists), np.concatenate(firsts)


def visited(model: Model, x: np.ndarray, counts: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and the lists they visit; ``counts`` has the rows whose first list it is."""
    rows, lists = [], []
    for part in blocks_of(len(x), len(model.centers)):
        asked = as_queries(x[part], model.longest)
        row, at, far = walk(model, asked, max(LOOK, model.ratio), model.least)
        keep = far <= model.ratio * np.maximum(far[np.searchsorted(row, row)], model.least)
        row, at = row[keep], at[keep]
        held = np.bincount(row, weights=counts[at], minlength=len(asked))
        for r in np.nonzero(held < enough)[0]:
            order = np.argsort(distances(asked[r : r + 1], model.centers)[0], kind="stable")
            order = order[: int(np.searchsorted(np.cumsum(counts[order]), enough)) + 1]
            more = np.setdiff1d(order, at[row == r])
            row, at = np.r_[row, np.full(len(more), r)], np.r_[at, more]
        rows.append(row + part.start)
        lists.append(at)
    return np.concatenate(rows), np.concatenate(lists)


def bounds(model: Model, x: np.ndarray, row: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
    """A score that ``k`` rows of the visited lists reach for sure (-inf: unknown)."""
    out = np.full(len(x), -np.inf)
    if len(model.rows) < k:
        return out
    for a in range(0, len(x), 64):
        b = min(a + 64, len(x))
        mine = (row >= a) & (row < b)
        seen = np.zeros((b - a, len(model.centers)), dtype=bool)
        seen[row[mine] - a, lists[mine]] = True
        close = np.where(seen[:, model.lists], x[a:b] @ model.rows.T, -np.inf)
        reached = np.partition(close, len(model.rows) - k, axis=1)[:, len(model.rows) - k]
        out[a:b] = reached - 1e-9 * np.abs(reached)
    out[~np.isfinite(out)] = -np.inf
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row number per distinct vector, and the number of its vector for every row."""
    _, first, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, which.ravel()


def smallest(ids: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """Rows with the ``k`` smallest ids of their vector, each id once, by vector and id."""
    order = np.lexsort((ids, which))
    a, b = which[order], ids[order]
    order = order[np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)]] if len(order) else order
    a = which[order]
    return order[np.arange(len(a)) - np.searchsorted(a, a) < k]


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows, in their own number type."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vec`` of the rows that take part, whatever their length."""
    kind = table.schema[vector_col].dataType.elementType.simpleString()
    vec: Column = table[vector_col] if kind in ("float", "double") else table[vector_col].cast("array<double>")
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0)
    return table.select(table[id_col].cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(good)


def postings(rows: DataFrame, model: Broadcast, k: int) -> DataFrame:
    """One row per row and list it is in; of a vector that repeats in a batch the ``k`` smallest ids."""
    kind = rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            first, which = distinct(x)
            kept = smallest(batch.column(0).to_numpy(), which, k)
            row, at, primary = assign(model.value, x[first].astype(np.float64))
            # The lists of a vector go to each of its rows.
            start, end = np.searchsorted(row, which[kept]), np.searchsorted(row, which[kept], side="right")
            pick = np.repeat(start - np.cumsum(end - start) + (end - start), end - start) + np.arange((end - start).sum())
            taken = batch.take(pa.array(np.repeat(kept, end - start)))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(at[pick].astype(np.int32)), pa.array(primary[pick])], names=["vec_id", "vec", "list", "is_first"])

    return rows.mapInArrow(run, f"vec_id long, vec {kind}, list int, is_first boolean")


class Parts(NamedTuple):
    """Where lists lie: number of the first part, number of parts, rows whose first list it is."""

    first: np.ndarray
    parts: np.ndarray
    counts: np.ndarray


def deal(sizes: dict[int, tuple[int, int]], lists: int) -> Parts:
    first, parts, counts = np.zeros(lists, dtype=np.int32), np.ones(lists, dtype=np.int32), np.zeros(lists, dtype=np.int64)
    part, held = 0, 0
    for c in range(lists):
        size, counts[c] = sizes.get(c, (0, 0))
        if held and held + size > PART_ROWS:
            part, held = part + 1, 0
        first[c], parts[c] = part, max(1, -(-size // PART_ROWS))
        held += size
        if parts[c] > 1:
            part, held = part + int(parts[c]), 0
    return Parts(first, parts, counts)


ROW = "part int, is_query boolean, lists array<int>, key1 long, key2 long, vec_id long, bound double"


def search_parts(dealt: DataFrame, k: int) -> DataFrame:
    """Rows of a part come first, then the queries that visit it: per query the best ``k`` rows of the part that reach its bound."""

    def score(part: list[pa.RecordBatch]):
        """Distinct vectors of the part with their ids, and the vectors of each list."""
        table = pa.Table.from_batches(part)
        x = matrix(table.column("vec").combine_chunks())
        first, which = distinct(x)
        ids, lists = table.column("vec_id").to_numpy(), table.column("lists").combine_chunks().flatten().to_numpy()
        kept = smallest(ids, which, k)
        pairs = np.unique(np.stack([lists, which], axis=1), axis=0)
        names, start = np.unique(pairs[:, 0], return_index=True)
        members = {int(c): m for c, m in zip(names, np.split(pairs[:, 1], start[1:]), strict=True)}
        return x[first].astype(np.float64), members, ids[kept], np.searchsorted(which[kept], np.arange(len(first) + 1))

    def answer(held, batch: pa.RecordBatch) -> pa.RecordBatch:
        x, members, ids, starts = held
        q = matrix(batch.column("vec")).astype(np.float64)
        lists = batch.column("lists")
        owner, asked = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        close = np.full((len(q), len(x)), -np.inf)
        for c in np.unique(asked):
            if int(c) in members:
                close[np.ix_(owner[asked == c], members[int(c)])] = q[owner[asked == c]] @ x[members[int(c)]].T
        close[close < batch.column("bound").to_numpy()[:, None]] = -np.inf
        width = min(k + SPARE, len(x))
        top = np.argpartition(-close, width - 1, axis=1)[:, :width]
        row, place = np.nonzero(np.isfinite(np.take_along_axis(close, top, axis=1)))
        node = top[row, place]
        exact = (q[row] * x[node]).sum(axis=1)
        own = (q[row] == x[node]).all(axis=1)
        n = starts[node + 1] - starts[node]
        row, exact, own = np.repeat(row, n), np.repeat(exact, n), np.repeat(own, n)
        found = ids[np.repeat(starts[node] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.lexsort((found, -exact, row))
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
        row = pa.array(row[order])
        return pa.RecordBatch.from_arrays([batch.column("key1").take(row), batch.column("key2").take(row), pa.array(found[order]), pa.array(exact[order]), pa.array(own[order])],
            names=["key1", "key2", "vec_id", "score", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held = None, [], None
        for batch in batches:
            change = np.nonzero((np.diff(batch.column("part").to_numpy()) != 0) | (np.diff(batch.column("is_query").to_numpy(zero_copy_only=False).astype(np.int8)) != 0))[0] + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                if not piece.num_rows:
                    continue
                if piece.column("part")[0].as_py() != part:
                    part, rows, held = piece.column("part")[0].as_py(), [], None
                if not piece.column("is_query")[0].as_py():
                    rows.append(piece)
                    continue
                if rows:
                    held, rows = score(rows), []
                if held is not None:
                    for c in range(0, piece.num_rows, QUERY_ROWS):
                        yield answer(held, piece.slice(c, QUERY_ROWS))

    return dealt.mapInArrow(run, "key1 long, key2 long, vec_id long, score double, own boolean")


def with_members(answers: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The answers of a vector for every query with it, its own row left out.

    Vectors with more than one query in 500, at most 500 of them, are dealt over more tasks by a short broadcast table.
    """
    total = queries.count()
    many = queries.groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, total // 500))
    many = F.broadcast(many.select("key1", "key2", F.ceil(F.col("n") / 1000).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    asked = queries.join(many, ["key1", "key2"], "left").select("vec_id", "key1", "key2", F.pmod(F.xxhash64("vec_id"), copies).cast("int").alias("copy"))
    listed = answers.groupBy("key1", "key2").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "own"))).alias("near"))
    listed = listed.join(many, ["key1", "key2"], "left").select("key1", "key2", "near", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    joined = asked.withColumnRenamed("vec_id", "query_id").join(listed, ["key1", "key2", "copy"])
    others = F.slice(F.filter("near", lambda r: ~(r["own"] & (r["vec_id"] == F.col("query_id")))), 1, k)
    found = joined.select("query_id", F.posexplode(others).alias("pos", "r"))
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest found for each query.

    ``is_query`` picks the queries by their column ``vec_id``.
    """
    spark = table.sparkSession
    every = vectors_of(table, id_col, vector_col)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    shape = every.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("square")).orderBy(F.desc("n"), "size").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = every.where(F.size("vec") == shape["size"])
    wanted = max(SAMPLE_PER_LIST * 64, min(SAMPLE_PER_LIST * MAX_LISTS, SAMPLE_BYTES // (8 * shape["size"])))
    share = min(1.0, wanted / shape["n"])
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    x = matrix(sample.select("vec").orderBy(F.xxhash64("vec")).limit(2 * wanted).toArrow().column(0).combine_chunks()).astype(np.float64)
    x = x[np.sort(distinct(x)[0])] if len(x) else np.ones((1, shape["size"]))
    model = fit(x, shape["n"], float(np.sqrt(shape["square"])), k)
    shared = spark.sparkContext.broadcast(model)
    held = stored(postings(rows, shared, k + 1), "vector-lists")
    sizes = {r["list"]: (r["n"], r["firsts"]) for r in held.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_first").alias("firsts")).toLocalIterator()}
    parts = spark.sparkContext.broadcast(deal(sizes, len(model.centers)))
    queries = rows.where(is_query).select("vec_id", "vec", F.xxhash64("vec").alias("key1"), F.xxhash64(F.lit(1), "vec").alias("key2"))
    asked = queries.groupBy("key1", "key2").agg(F.first("vec").alias("vec"))
    kind = rows.schema["vec"].dataType.simpleString()

    @F.pandas_udf("int")
    def part_of(lists: pd.Series, ids: pd.Series) -> pd.Series:
        at = lists.to_numpy()
        return pd.Series(parts.value.first[at] + ids.to_numpy() % parts.value.parts[at])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2)).astype(np.float64)
            row, at = visited(shared.value, x, p.counts, k + 1)
            bound = bounds(shared.value, x, row, at, k + 1)
            n = p.parts[at]
            row, at, part = np.repeat(row, n), np.repeat(at, n), np.repeat(p.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            order = np.lexsort((at, part, row))
            row, at, part = row[order], at[order], part[order]
            new = np.nonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(part) != 0)])[0]
            taken = batch.take(pa.array(row[new]))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array(at, pa.int32()))
            none = pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[new], pa.int32()), pa.array(np.ones(len(new), bool)), lists, taken.column(0), taken.column(1), none, pa.array(bound[row[new]]), taken.column(2)],
                names=["part", "is_query", "lists", "key1", "key2", "vec_id", "bound", "vec"])

    none = F.lit(None).cast("long")
    placed = held.select(part_of("list", "vec_id").alias("part"), F.lit(False).alias("is_query"), F.array("list").alias("lists"), none.alias("key1"), none.alias("key2"), "vec_id", F.lit(None).cast("double").alias("bound"), "vec")
    dealt = placed.unionByName(asked.select("key1", "key2", "vec").mapInArrow(visits, f"{ROW}, vec {kind}"))
    found = search_parts(spread(dealt, "part").sortWithinPartitions("part", "is_query"), k + 1)
    # A row lies in several lists, so it may come from several parts.
    found = found.dropDuplicates(["key1", "key2", "vec_id", "score"])
    place = F.row_number().over(Window.partitionBy("key1", "key2").orderBy(F.desc("score"), "vec_id"))
    return with_members(found.withColumn("place", place).where(F.col("place") <= k + 1), queries.select("vec_id", "key1", "key2").distinct(), k)
