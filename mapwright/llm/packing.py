"""Packing documents into fixed-length sequences along a Hilbert curve.

Every document's tokens are hashed into a few random directions; the mean signs are its place in a small cube, and the
Hilbert index of that place is its key. Documents are range-sorted by key and laid end to end, so the neighbours along the
curve share sequences. A document is cut where a sequence ends; only the last sequence can need padding.

Three passes: tokens are written once as packed bytes; the order is found from keys and counts alone, with running sums
inside range partitions and one total per partition on the driver; then places are joined to the tokens and cut.

A null or empty text is the end token alone. Repeated rows are packed each; rows are told apart by a number given when the
tokens are written. An empty table gives an empty result. A null id stays null.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import LETTERS, NOT_PLAIN, NUMBERS, SPACES, Recent, byte_level, map_rows, small_batches, stored, texts
from mapwright.llm.token_counts import load, special_strings

SEQUENCE, END_ID = 4096, 2
#: Directions, and bits of each coordinate on the curve.
DIMENSIONS, BITS = 3, 16
LONG_TEXT = 1 << 20
#: Words of a generation of the cache.
CACHED = 200_000

# The word pattern of the lower-casing tokenizer, written for the plain alphabet.
WORDS = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def pack_ids(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a whole text as unsigned 32-bit little-endian bytes, equal to the tokenizer's own."""
    tokenizer = load(path)
    special = re.compile("|".join(re.escape(s.lower()) for s in special_strings(path)) or "(?!)")

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    model = tokenizer.model
    look = Recent(lambda word: pack_ids([t.id for t in model.tokenize(byte_level(word))]), CACHED).__getitem__

    def encode(text: str) -> bytes:
        lowered = text.lower()
        # In ASCII texts all classes agree, control characters included.
        if not text.isascii() and NOT_PLAIN.search(text) or special.search(lowered):
            return whole(text)
        if len(text) > LONG_TEXT:
            return b"".join(look(m.group()) for m in WORDS.finditer(lowered))
        return b"".join(map(look, WORDS.findall(lowered)))

    return encode


def id_width(path: str) -> int:
    """Bytes that hold any id of the vocabulary (the end id included) while tokens are stored and moved."""
    return 2 if load(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def signs(ids: np.ndarray) -> np.ndarray:
    """One pseudo-random sign for each id and direction."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.stack([((mixed >> np.uint64(d)) & np.uint64(1)).astype(np.float64) * 2 - 1 for d in range(DIMENSIONS)])


def hilbert(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (one per row), by Skilling's transposed form."""
    x = [places[:, d].astype(np.int64).copy() for d in range(places.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ turn) >> b) & 1)
    return out


def curve_keys(coded: list[bytes], table: np.ndarray) -> np.ndarray:
    """Key of each document: mean signs of its ids, spread over the cube, on the curve."""
    means = np.zeros((len(coded), DIMENSIONS))
    for i, c in enumerate(coded):
        ids = np.frombuffer(c, dtype="<u4")
        if len(ids):
            means[i] = table[:, ids].mean(axis=1) if ids.max() < table.shape[1] else signs(ids).mean(axis=1)
    side = (1 << BITS) - 1
    return hilbert(np.round((np.clip(means, -1, 1) + 1) / 2 * side).astype(np.int64))


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``doc_id``, ``curve``, ``doc_tokens`` and ``ids`` (narrow if they fit), written to the shared folder."""
    small_batches(docs.sparkSession)
    narrow = texts(docs, id_col, text_col)
    width = id_width(path)
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def make():
        encode = encoder(path)
        table = signs(np.arange(1 << 16))

        def work(batch: pa.RecordBatch) -> dict:
            coded = [encode(t) for t in batch.column(1).to_pylist()]
            narrow = coded if width == 4 else [np.frombuffer(c, "<u4").astype("<u2").tobytes() for c in coded]
            sizes = np.array([len(c) // 4 + 1 for c in coded], np.int64)
            return {"doc_id": batch.column(0), "curve": curve_keys(coded, table), "doc_tokens": sizes, "ids": pa.array([c + end for c in narrow], pa.binary())}

        return work

    coded = map_rows(narrow, make, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, curve long, doc_tokens long, ids binary")
    return stored(coded.withColumn("row", F.monotonically_increasing_id()), "packing-tokens")


def places(tokens: DataFrame) -> DataFrame:
    """``row`` and ``at``: each document's first place in the one stream along the curve."""
    spark = tokens.sparkSession

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for frame in frames:
            sums = total + frame["doc_tokens"].cumsum()
            yield pd.DataFrame({"row": frame["row"], "part": part, "before": sums - frame["doc_tokens"], "doc_tokens": frame["doc_tokens"]})
            total = int(sums.iloc[-1]) if len(sums) else total

    keys = tokens.select("curve", "row", "doc_tokens")
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(number, "curve", "row").sortWithinPartitions("curve", "row")
    summed = stored(ranged.mapInPandas(running, "row long, part int, before long, doc_tokens long"), "packing-order")
    starts, total = [], 0
    for part, n in sorted(summed.groupBy("part").agg(F.sum("doc_tokens")).collect()):  # a row for each partition
        starts.append((part, total))
        total += n
    first = spark.createDataFrame(starts, "part int, first long")
    return summed.join(F.broadcast(first), "part").select("row", (F.col("first") + F.col("before")).alias("at"))


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document: where it starts there, its sequence, its offset and its ids."""
    tokens = tokenised(docs, path, end_id, id_col, text_col)
    laid = tokens.select("row", "doc_id", "doc_tokens", "ids").join(places(tokens), "row").drop("row")
    kind = laid.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    width = id_width(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                at, size = batch.column(3).to_numpy(), batch.column(1).to_numpy()
                count = (at + size - 1) // sequence - at // sequence + 1
                row = np.repeat(np.arange(len(at)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                number = at[row] // sequence + k
                begin = np.maximum(at[row], number * sequence)
                end = np.minimum(at[row] + size[row], (number + 1) * sequence)
                start = begin - at[row]
                held = batch.column(2)
                views = [memoryview(held[i].as_buffer()) for i in range(len(at))]
                parts = [np.frombuffer(views[r][width * s : width * (s + n)], f"<u{width}").astype("<u4").tobytes() for r, s, n in zip(row.tolist(), start.tolist(), (end - begin).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(parts, pa.binary()), pa.array(size[row]), pa.array(number), pa.array(begin - number * sequence)], names=names)

    return laid.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows with about ``limit`` tokens at a time."""
    if not batch.num_rows:
        return
    group = np.cumsum(batch.column(1).to_numpy()) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids of their pieces in order, at most one sequence's length in a row."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(held, F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces(docs, path, sequence).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
