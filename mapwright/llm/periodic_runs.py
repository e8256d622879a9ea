"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q that is at least ``max(shortest, exponent * q)`` words long
and that no neighbouring word extends. All words of a slice of documents are handled at once as numbers:

* per power of two, equal stretches of that length in a document get the same name (the pair of names of their halves);
  stretches that occur once in their document drop out, so ordinary text leaves after a few levels;
* the next occurrence of a name within twice its length, met a second time at the same distance, is an arithmetic
  progression and proposes that distance as a period. With an exponent of 4 or more each run shows such a progression at
  the level just below its period: a primitive word of length q has a stretch of that length that occurs once in it. And
  a proposal long enough to be a run has no smaller period, because the smaller one would be the next occurrence;
* names from the longest to the shortest tell in a few steps how far a proposal reaches to both sides; equal ones are merged.

Words are what lies between ASCII white space, in whole texts of any length. Null, empty and blank texts have no words and
no runs. Rows are handled one by one: repeated rows and ids give repeated results, a null id stays null, an empty table
gives an empty result. Only the id and the text are read, so other columns may have any name. Of runs of equal length the
first is the one with the smallest start, then the smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mapwright.llm.common import map_rows, rows, small_batches, texts

#: A run has this many words and periods at least.
SHORTEST, EXPONENT = 6, 4


class Runs(NamedTuple):
    """Runs by start, then period; places count over all words of the slice."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def name_pairs(places: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place: a name shared by equal keys (-1 where the key occurs once) and the distance to the next equal key (0: none)."""
    names, gap = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    same = keys[1:] == keys[:-1]
    gap[places[:-1][same]] = np.diff(places)[same]
    repeated = np.zeros(len(keys), dtype=bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    head = np.r_[True, ~same] if len(keys) else np.zeros(0, dtype=bool)
    names[places[repeated]] = (np.cumsum(head & repeated) - 1)[repeated]
    return names, gap


def proposals(gap: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods: progressions of three occurrences within reach, one for neighbouring places of the same period."""
    at = np.nonzero((gap > 0) & (gap <= 2 * width))[0]
    at = at[gap[at + gap[at]] == gap[at]]
    period = gap[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(period) != 0)
    return at[new].astype(np.int64), period[new].astype(np.int64)


def find_all(words: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> Runs:
    """The runs of numbered words; ``doc`` numbers the document of each word, in order."""
    size = len(words)
    if not size:
        return Runs(*(np.zeros(0, dtype=np.int64),) * 3)
    names, gap = name_pairs(np.arange(size), doc.astype(np.int64) * (int(words.max()) + 1) + words, size)
    levels, places, periods, width = [names], [], [], 1
    while True:
        at, period = proposals(gap, width)
        places.append(at)
        periods.append(period)
        alive = np.nonzero((names[: max(0, size - width)] >= 0) & (names[width:] >= 0) & (doc[: max(0, size - width)] == doc[width:]))[0]
        pairs = names[alive].astype(np.int64) * (int(names.max()) + 1) + names[alive + width]
        names, gap = name_pairs(alive, pairs, size)
        width *= 2
        if names.max() < 0:
            break
        levels.append(names)
    at, period = np.concatenate(places), np.concatenate(periods)
    low, high = at.copy(), at + period
    for k in reversed(range(len(levels))):
        last = np.minimum(high, size - 1)
        name = levels[k][last]
        step = (high < size) & (name >= 0) & (name == levels[k][np.minimum(low, size - 1)])
        low[step] += 1 << k
        high[step] += 1 << k
    end = high
    low, high = at.copy(), at + period
    for k in reversed(range(len(levels))):
        name = levels[k][np.maximum(low - (1 << k), 0)]
        step = (low >= 1 << k) & (name >= 0) & (name == levels[k][np.maximum(high - (1 << k), 0)])
        low[step] -= 1 << k
        high[step] -= 1 << k
    length = end - low
    keep = length >= np.maximum(shortest, exponent * period)
    low, length, period = low[keep], length[keep], period[keep]
    order = np.lexsort((period, low))
    low, length, period = low[order], length[order], period[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (np.diff(low) != 0) | (np.diff(period) != 0)
    return Runs(low[new], length[new], period[new])


def repeats(runs: Runs, size: int) -> np.ndarray:
    """Which words lie in a run after its first period."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.start + runs.length, -1)
    return np.cumsum(edge)[:size] > 0


class Slice(NamedTuple):
    """Words and runs of some documents: document k has words ``first[k]`` to ``first[k + 1]`` and runs ``run[k]`` to ``run[k + 1]``."""

    words: list[list[bytes]]
    first: np.ndarray
    run: np.ndarray
    runs: Runs


def analyse(words: list[list[bytes]], shortest: int, exponent: int) -> Slice:
    number = defaultdict(count().__next__)
    first = np.cumsum([0, *[len(w) for w in words]])
    flat = np.fromiter((number[w] for doc in words for w in doc), dtype=np.int64, count=int(first[-1]))
    runs = find_all(flat, np.repeat(np.arange(len(words), dtype=np.int32), np.diff(first)), shortest, exponent)
    return Slice(words, first, np.searchsorted(runs.start, first), runs)


def check(exponent: int) -> None:
    if exponent < 4:
        raise ValueError("exponent: runs of under four periods need not show three equal steps")


def split(text: str) -> list[bytes]:
    """Words between ASCII white space; other spaces are part of a word."""
    return text.encode("utf-8", "surrogatepass").split()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """One row per run: ``doc_id``, ``start`` (number of its first word, from 0), ``length`` and ``period`` in words."""
    check(exponent)
    narrow = texts(docs, id_col, text_col)
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], dict]:
        def work(batch: pa.RecordBatch) -> dict:
            s = analyse([split(t) for t in batch.column(1).to_pylist()], shortest, exponent)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(s.run))
            return {"doc_id": batch.column(0).take(pa.array(owner)), "start": s.runs.start - s.first[owner], "length": s.runs.length, "period": s.runs.period}

        return work

    small_batches(docs.sparkSession)
    return map_rows(narrow, make, f"doc_id {id_type}, start long, length long, period long")


def collapse_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """The rows with every run cut down to its first period; all other columns and all texts without a run are unchanged.

    Words of a changed text are joined by one space.
    """
    check(exponent)
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            column = batch.column(at).to_pylist()
            s = analyse([split(t or "") for t in column], shortest, exponent)
            gone = repeats(s.runs, int(s.first[-1]))
            for k in np.nonzero(np.diff(s.run))[0]:
                column[k] = kept_words(s, gone, k).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array(column, batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns)], names=schema.names)

    return docs.mapInArrow(run, schema)


def kept_words(s: Slice, gone: np.ndarray, k: int) -> bytes:
    if s.run[k] == s.run[k + 1]:
        return b" ".join(s.words[k])
    return b" ".join([s.words[k][i] for i in np.nonzero(~gone[s.first[k] : s.first[k + 1]])[0]])


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's rewriting: for one id in ten, which word stands at each place; None where the text stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per document: number of runs, the longest run (nulls without one), hashes of all runs and of the collapsed text.

    ``rewrite`` may reorder the words of a document before they are searched.
    """
    narrow = texts(docs, id_col, text_col)
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], dict]:
        def work(batch: pa.RecordBatch) -> dict:
            words = [split(t) for t in batch.column(1).to_pylist()]
            if rewrite is not None:
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    order = rewrite(doc_id, len(words[k]))
                    if order is not None:
                        words[k] = [words[k][i] for i in order.tolist()]
            s = analyse(words, SHORTEST, EXPONENT)
            gone = repeats(s.runs, int(s.first[-1]))
            out = {name.split()[0]: [] for name in DIGEST.split(", ")}
            for k in range(len(words)):
                a, b = s.run[k], s.run[k + 1]
                start, length, period = (v[a:b].tolist() for v in s.runs)
                start = [x - int(s.first[k]) for x in start]
                best = min(zip([-x for x in length], start, period, strict=True), default=None)
                out["n_runs"].append(b - a)
                out["start"].append(best and best[1])
                out["length"].append(best and -best[0])
                out["period"].append(best and best[2])
                out["exponent_milli"].append(best and 1000 * -best[0] // best[2])
                listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(start, length, period, strict=True))
                out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(kept_words(s, gone, k)).hexdigest())
            return {"doc_id": batch.column(0)} | {n: pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in out.items()}

        return work

    small_batches(docs.sparkSession)
    return map_rows(narrow, make, f"doc_id {id_type}, {DIGEST}")
