"""Lower-dimensional forms: truncated SVD of term weights and the two-dimensional layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.functions import vectors as VX
from mapwright.operators import tfidf
from mapwright.sources.storage import scratch_folder, spread

# Random directions beyond the wanted ones, and passes that sharpen them.
OVERSAMPLE, PASSES = 10, 5
# Most used terms a reduction works on, unless the caller says otherwise; it bounds the matrices on the driver.
VOCABULARY_LIMIT = 5000
# Rows multiplied at once, lines of a partial sum in a block, partial sums added at once.
CHUNK_ROWS, BLOCK_LINES, FAN = 256, 512, 32
# A task's sum: blocks of its lines.
SUMS = "task long, block int, data binary"
# Finished vectors taken at once.
VECTOR_ROWS = 2048


class FittedSvd:
    """Vocabulary and right singular vectors; at most 5000 terms by 256."""

    def __init__(self, terms: list[str], idf: list[float], basis: np.ndarray, singular: np.ndarray, rows: int):
        self.terms, self.idf, self.basis, self.singular, self.rows = terms, idf, basis, singular, rows

    @property
    def explained(self) -> float:
        """Part of the squared weights the kept directions carry; every row has length one."""
        return float((self.singular**2).sum() / self.rows) if self.rows else 0.0

    def vocabulary(self, spark) -> DataFrame:
        rows = [(w, i, float(v)) for i, (w, v) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "term string, position int, idf double")


def _chunks(batches: Iterator[pa.RecordBatch], width: int, kind: type = np.float32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of term weights a few at a time: the terms they use, and a matrix over those terms alone."""
    for batch in batches:
        offsets = batch.column(0).offsets.to_numpy()
        terms, weights = (c.values.to_numpy() for c in batch.columns)
        for start in range(0, batch.num_rows, CHUNK_ROWS):
            ends = offsets[start : start + CHUNK_ROWS + 1]
            mine = terms[ends[0] : ends[-1]]
            place = np.zeros(width, dtype=np.int64)
            place[mine] = 1
            used = np.flatnonzero(place)
            place[used] = np.arange(len(used))
            matrix = np.zeros((len(ends) - 1, len(used)), dtype=kind)
            matrix[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), place[mine]] = weights[ends[0] : ends[-1]]
            yield used, matrix


def _add_blocks(table: pa.Table) -> pa.Table:
    """The blocks of one place, added up; there are at most ``FAN`` of them."""
    total = sum(np.frombuffer(b.as_py()) for b in table.column("data"))
    return pa.table({"task": table.column("task")[:1], "block": table.column("block")[:1], "data": pa.array([total.tobytes()], pa.binary())})


def _blocks(total: np.ndarray | None, task: int) -> Iterator[pa.RecordBatch]:
    """A task's sum as blocks of lines; none if it had no rows."""
    for block in range(0, 0 if total is None else len(total), BLOCK_LINES):
        data = pa.array([total[block : block + BLOCK_LINES].tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([block], pa.int32()), data], names=["task", "block", "data"])


def _sum_over_rows(rows: DataFrame, width: int, shape: tuple[int, int], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Matrix that ``add(total, used, matrix)`` fills from all rows.

    Each task sums its own rows; the sums travel as blocks of lines and are added ``FAN`` at a time by a tree of tasks,
    so neither the driver nor one task sees more than ``FAN`` of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = None, TaskContext.get().partitionId()
        for used, matrix in _chunks(batches, width):
            total = np.zeros(shape) if total is None else total
            add(total, used, matrix)
        yield from _blocks(total, task)

    return _added_up(rows.select("positions", "weights").mapInArrow(run, SUMS), rows.rdd.getNumPartitions(), shape)


def _added_up(sums: DataFrame, tasks: int, shape: tuple[int, int]) -> np.ndarray:
    """One matrix out of the tasks' sums, which come as blocks of lines."""
    while tasks > 1:
        sums = sums.withColumn("task", F.expr(f"task div {FAN}")).groupBy("task", "block").applyInArrow(_add_blocks, SUMS)
        tasks = -(-tasks // FAN)
    out = np.zeros(shape)
    for _, block, data in sums.toLocalIterator():
        part = np.frombuffer(bytes(data)).reshape(-1, shape[1])
        out[block : block + len(part)] += part
    return out


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder; every later pass reads the files."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _weighted_rows(counts: DataFrame, fitted: FittedSvd, key: str) -> DataFrame:
    # At most the limit's terms: sent to the tasks, so the pairs are not dealt by term, of which some have a pair in every text.
    vocab = F.broadcast(fitted.vocabulary(counts.sparkSession))
    return spread(tfidf.sparse_rows(tfidf.transform(counts, vocab, key), vocab, key), key)


def _fitted_rows(counts: DataFrame, ids: DataFrame, key: str, components: int, limit: int, seed: int) -> tuple[FittedSvd, DataFrame]:
    """The fit and the weighted rows it was made from, written once."""
    vocab_rows = tfidf.fit_vocabulary(counts, ids, limit).orderBy("term").collect()
    if not vocab_rows:
        raise ValueError("no term left to fit on")
    spark = counts.sparkSession
    terms, idf = [r["term"] for r in vocab_rows], [r["idf"] for r in vocab_rows]
    fitted = FittedSvd(terms, idf, np.zeros((0, 0)), np.zeros(0), 0)
    rows = _written(_weighted_rows(counts, fitted, key), "term-weights")
    fitted.rows = rows.count()
    width = len(terms)
    k = max(1, min(components, width, fitted.rows))
    wide = min(k + OVERSAMPLE, width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, wide)))[0]
    for _ in range(PASSES if wide < width else 0):
        # Single precision is enough here: the directions are made orthogonal in double precision after each pass.
        held = spark.sparkContext.broadcast(q.astype(np.float32))

        def spread_out(total: np.ndarray, used: np.ndarray, matrix: np.ndarray, held=held) -> None:
            total[used] += matrix.T @ (matrix @ held.value[used])

        q = np.linalg.qr(_sum_over_rows(rows, width, (width, wide), spread_out))[0]
        held.unpersist()
    held = spark.sparkContext.broadcast(q)

    def squares(total: np.ndarray, used: np.ndarray, matrix: np.ndarray) -> None:
        projected = matrix @ held.value[used]
        total += projected.T @ projected

    values, vectors = np.linalg.eigh(_sum_over_rows(rows, width, (wide, wide), squares))
    best = np.argsort(values)[::-1][:k]
    basis = q @ vectors[:, best]
    lead = np.argmax(np.abs(basis), axis=0)
    fitted.basis = basis * np.where(basis[lead, np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    fitted.singular = np.sqrt(np.maximum(values[best], 0.0))
    return fitted, rows


def fit_svd(counts: DataFrame, ids: DataFrame, key: str, components: int = 256, limit: int = VOCABULARY_LIMIT, seed: int = 42) -> FittedSvd:
    """Randomised truncated SVD of the weighted term counts in a fixed number of passes.

    Only the vocabulary and vocabulary-by-component matrices come to the driver; both are
    bounded by ``limit`` and ``components``, whatever the number of documents.
    """
    return _fitted_rows(counts, ids, key, components, limit, seed)[0]


def _projected(rows: DataFrame, fitted: FittedSvd, ids: DataFrame, key: str) -> DataFrame:
    """Ids meet their few weights, not the finished vectors, which are several times as long; without a term they get zeros."""
    shared = ids.sparkSession.sparkContext.broadcast(fitted.basis)
    width, schema = len(fitted.terms), f"{key} {ids.schema[key].dataType.simpleString()}, embedding array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for used, matrix in _chunks(iter([batch.select([1, 2])]), width, np.float64):
                v = matrix @ shared.value[used]
                length = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
                v = np.divide(v, length, out=v, where=length > 0)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(v)), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=[key, "embedding"])
                done += len(v)

    held = ids.select(key).join(rows, key, "left")
    none = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("positions", "weights")]
    return held.select(key, *none).mapInArrow(run, schema)


def project_svd(counts: DataFrame, fitted: FittedSvd, ids: DataFrame, key: str) -> DataFrame:
    """Reduced vector of length one per id; ids without a known term get zeros."""
    return _projected(_weighted_rows(counts, fitted, key), fitted, ids, key)


def embed_texts(docs: DataFrame, ids: DataFrame, key: str, text: str, stopwords, components: int = 256,
                limit: int = VOCABULARY_LIMIT) -> tuple[DataFrame, FittedSvd]:
    """Fit and project in one go; texts are tokenised once, and counts and weighted rows written once.

    Texts are dealt out first, as the input may lie in few files; by text too, so the texts of one id may lie apart.
    """
    counts = _written(tfidf.term_counts(spread(docs.select(key, text), key, text), key, text, stopwords), "term-counts")
    fitted, rows = _fitted_rows(counts, ids, key, components, limit, 42)
    return _projected(rows, fitted, ids, key), fitted


def layout_2d(vectors: DataFrame, key: str, vector: str = "embedding", only: DataFrame | None = None) -> DataFrame:
    """Position of each entity on the plane of the two strongest directions, signs fixed.

    The plane is that of all vectors; ``only``, some of their rows, are placed if no others are wanted.
    """
    axes = _widest_directions(vectors.select(VX.doubles(F.col(vector)).alias("v")))
    axes = axes * [-1.0 if axes[np.argmax(np.abs(axes[:, i])), i] < 0 else 1.0 for i in range(2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, VECTOR_ROWS):
                part = batch.slice(start, VECTOR_ROWS)
                rows = VX.rows_of(part.column(1), len(axes))
                # Sums along a row, so that a place does not depend on the rows beside it.
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array((rows * axes[:, i]).sum(axis=1)) for i in range(2)]], names=[key, "x", "y"])

    rows = vectors if only is None else only
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, x double, y double"
    return rows.select(key, VX.doubles(F.col(vector)).alias("v")).mapInArrow(run, schema)


def _widest_directions(vectors: DataFrame) -> np.ndarray:
    """The two directions in which the vectors (``v``) vary most, from one pass that adds up their products.

    Taken from the first vector on, so a large part that all vectors share costs no digits.
    """
    first = vectors.first()
    if first is None or first["v"] is None:
        raise ValueError("no vector to lay out")
    start = np.array([x or 0.0 for x in first["v"]])
    if len(start) < 2:
        raise ValueError("vectors of one element have no second direction")
    shape = (len(start) + 1, len(start) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = None, TaskContext.get().partitionId()
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTOR_ROWS):
                rows = VX.rows_of(batch.column(0).slice(begin, VECTOR_ROWS), len(start))
                # A last column of ones brings the sums and the number of rows along.
                rows = np.hstack([rows - start, np.ones((len(rows), 1))])
                total = np.zeros(shape) if total is None else total
                total += rows.T @ rows
        yield from _blocks(total, task)

    sums = _added_up(vectors.mapInArrow(run, SUMS), vectors.rdd.getNumPartitions(), shape)
    count = sums[-1, -1]
    if count < 2:
        raise ValueError("one vector alone varies in no direction")
    spread_of = (sums[:-1, :-1] - np.outer(sums[-1, :-1], sums[-1, :-1]) / count) / (count - 1)
    return np.linalg.svd(spread_of)[0][:, :2]
