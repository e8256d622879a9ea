"""Byte-balanced shards by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts are neighbours; every row has a 16-byte order key. Splitters
between shards are found by counting: each round counts the exact bytes and rows below a set of candidate keys in all
partitions, then narrows the interval around every splitter that misses its tolerance. When all splitters stand, one
exchange moves the rows to pieces of shards, and slots follow from the exact row counts of the pieces.

Only histograms reach the driver: at most ``CANDIDATES`` candidates for each of ``shards * pieces`` splitters. A group of
equal texts that is larger than a shard is cut between ids; rows that agree in text and id stay together, in any order.

A null text has no bytes. A null id sorts as the smallest id. With fewer rows than shards, some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapwright.llm.common import free_name, stored

#: Candidate keys tried at once inside a splitter's interval, and the most rounds (each divides the interval).
CANDIDATES, ROUNDS = 16, 40
#: Share of a shard's bytes by which a boundary between shards may miss; pieces within a shard may miss by more.
TOLERANCE, PIECE_TOLERANCE = 0.0002, 0.25
KEY_BYTES = 16


def to_bytes(value: int) -> bytes:
    return value.to_bytes(KEY_BYTES, "big")


def count_below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe; ``keys`` has columns key and size."""
    edges = keys.sparkSession.sparkContext.broadcast(np.array([to_bytes(p) for p in probes], dtype=f"S{KEY_BYTES}"))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, number = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=f"S{KEY_BYTES}")
                at = np.searchsorted(edges.value, own, side="right")
                size += np.bincount(at, batch.column(1).to_numpy().astype(np.float64), len(size)).astype(np.int64)
                number += np.bincount(at, minlength=len(number))
        used = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(number[used])], names=["bin", "size", "n"])

    found = keys.mapInArrow(histogram, "bin long, size long, n long").groupBy("bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, number = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for b, s, n in found:
        size[b], number[b] = s, n
    return np.cumsum(size)[:-1], np.cumsum(number)[:-1]


def splitters(keys: DataFrame, shards: int, pieces: int) -> tuple[list[int], list[int], int]:
    """Boundaries of ``shards * pieces`` pieces, the rows below each, and all rows."""
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    top = 1 << (8 * KEY_BYTES)
    parts = shards * pieces
    share = total / parts
    goals = [share * i for i in range(1, parts)]
    room = [(TOLERANCE if i % pieces == 0 else PIECE_TOLERANCE / pieces) * total / shards for i in range(1, parts)]
    low, high = [0] * len(goals), [top] * len(goals)
    low_at, high_at = [(0, 0)] * len(goals), [(total, rows)] * len(goals)
    best: list[tuple[float, int, int]] = [(g, 0, 0) for g in goals]
    for _ in range(ROUNDS):
        asked = [i for i, g in enumerate(goals) if best[i][0] > room[i] and high[i] - low[i] > 1]
        if not asked:
            break
        probes: set[int] = set()
        for i in asked:
            width = high[i] - low[i]
            probes.update(low[i] + width * k // (CANDIDATES + 1) for k in range(1, CANDIDATES + 1))
            # Keys are spread evenly almost everywhere, so the proportional place is a good guess.
            gap = high_at[i][0] - low_at[i][0]
            if gap > 0:
                aim = low[i] + int(width * min(1.0, max(0.0, (goals[i] - low_at[i][0]) / gap)))
                probes.update(min(high[i] - 1, max(low[i] + 1, aim + width * k // 256)) for k in (-2, -1, 0, 1, 2))
        ordered = sorted(p for p in probes if 0 < p < top)
        size, number = count_below(keys, ordered)
        values = size.tolist()
        for i in asked:
            at = int(np.searchsorted(size, goals[i], side="left"))
            for j in (at - 1, at):
                if 0 <= j < len(ordered) and abs(values[j] - goals[i]) < best[i][0]:
                    best[i] = (abs(values[j] - goals[i]), ordered[j], int(number[j]))
            if at > 0 and ordered[at - 1] > low[i]:
                low[i], low_at[i] = ordered[at - 1], (values[at - 1], int(number[at - 1]))
            if at < len(ordered) and ordered[at] < high[i]:
                high[i], high_at[i] = ordered[at], (values[at], int(number[at]))
    edges, below = [], []
    for _, edge, number in best:  # boundaries never cross, even where a shard is empty
        if edges and edge < edges[-1]:
            edge, number = edges[-1], below[-1]
        edges.append(edge)
        below.append(number)
    return edges, below, rows


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = 16, pieces: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns with ``size``, ``shard`` and ``slot``; the operator's columns replace columns of the same name."""
    spark = docs.sparkSession
    pieces = pieces or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    key, piece, first_row = (free_name(docs.columns, n) for n in ("order_key", "piece", "first_row"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # Unsigned byte order of (text hash, id): signs flipped, each part big-endian.
    flip = lambda c: F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    order = F.concat(flip(F.xxhash64(text)), flip(F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))))
    keyed = docs.select(*[docs[c] for c in kept], (F.octet_length(text).cast("long") + overhead).alias("size"), order.alias(key))
    keys = stored(keyed.select(F.col(key).alias("key"), "size"), "shard-keys")
    edges, below, _ = splitters(keys, shards, pieces)
    shared = spark.sparkContext.broadcast(np.array([to_bytes(e) for e in edges], dtype=f"S{KEY_BYTES}"))

    @F.pandas_udf("int")
    def piece_of(own: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, np.frombuffer(b"".join(own), dtype=f"S{KEY_BYTES}"), side="right").astype(np.int32))

    starts = [0, *below]
    first = spark.createDataFrame([(i, i // pieces, n - starts[i // pieces * pieces]) for i, n in enumerate(starts)], f"{piece} int, shard int, {first_row} long")
    placed = keyed.withColumn(piece, piece_of(key)).join(F.broadcast(first), piece)  # a row for each piece
    slot = F.col(first_row) + F.row_number().over(Window.partitionBy(piece).orderBy(key)) - 1
    return placed.withColumn("slot", slot.cast("long")).select(*kept, "size", "shard", "slot")
