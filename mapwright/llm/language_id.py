"""Language identification by cross-parsing entropy.

Each language is a suffix automaton of labelled text. A document is parsed greedily into the longest phrases that occur in
the language's text (longest-match lengths from the automaton); the language that needs the fewest normalised phrases wins:
``phrases * log2(length of the language's text) / length of the document``.

The automata are fitted on a bounded sample (the parameters below) of rows with a language. Texts are parsed whole, in blocks
of ``BLOCK`` symbols, so a text of any length needs the same memory per block.

A null text, an empty text and a text without a letter get ``und`` with score 0; so does every text when nothing was
learned. Ties go to the language whose name sorts first. Repeated rows get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapwright.llm.common import map_rows, rows, small_batches, stored, texts

#: The fitting sample: rows of a language, characters of a row, symbols of a language, and symbols of all languages together.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_SYMBOLS, ALL_SYMBOLS = 200, 20_000, 30_000, 1 << 18
#: Automata of languages with up to so many letters keep all transitions in a table, others only those there are.
TABLE_SYMBOLS = 200
#: So many times the rows wanted pass the bound on hashes, so that enough of them do.
MARGIN = 4
#: A long row gives its characters, and then its symbols, from so many places of the text at most, with so many symbols each at least.
PLACES, PLACE_SYMBOLS = 4, 64
BLOCK = 256
#: How fast the score falls with the lead in bits per symbol.
SHARPNESS = 12.0
UNKNOWN, SPACE = 0, 1


def symbols(text: str, code: np.ndarray) -> np.ndarray:
    """Lower-cased letters as symbols; everything else is a space, runs of spaces are one, one stands at either end."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    out = code[points]
    space = out == SPACE
    return out[np.concatenate(([True], ~(space[1:] & space[:-1])))]


def letter_points() -> np.ndarray:
    """Each letter's code point stands for itself, the rest is a space; no letter has a code point as small as the two symbols."""
    letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return np.where(letter, np.arange(0x110000), SPACE).astype(np.int32)


def letter_codes(points: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Symbol of each code point: 2 and up for the letters ``known``, unknown for other letters, the rest a space."""
    code = np.where(points == SPACE, SPACE, UNKNOWN).astype(np.min_scalar_type(len(known) + 1))
    code[known] = np.arange(2, len(known) + 2)
    return code


class Sparse(NamedTuple):
    """Transitions that exist: ``state * width + symbol`` in order, and where they lead; the last state leads nowhere."""

    keys: np.ndarray
    to: np.ndarray
    width: int
    dead: int

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        wanted = state * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.to[at], -1)


class Table(NamedTuple):
    """All transitions, states by symbols, in one row; -1 where there is none."""

    flat: np.ndarray
    width: int
    dead: int

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.flat[state * self.width + symbol]


def suffix_automaton(sequence: np.ndarray, width: int) -> np.ndarray | Sparse:
    """Transitions of the automaton of all substrings: states by symbols, -1 where none; the last state leads nowhere."""
    step = transitions(sequence)
    if width > TABLE_SYMBOLS + 2:
        pairs = np.array([(state * width + c, to) for state, row in enumerate(step) for c, to in sorted(row.items())], dtype=np.int64)
        return Sparse(pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), width, len(step))
    moves = np.full((len(step) + 1, width), -1, dtype=np.int32)
    for state, row in enumerate(step):
        for c, to in row.items():
            moves[state, c] = to
    return moves


def transitions(sequence: np.ndarray) -> list[dict[int, int]]:
    """Where each state of the automaton leads by each symbol."""
    link, size, step = [-1], [0], [{}]
    last = 0
    for c in sequence.tolist():
        if c == UNKNOWN:
            last = 0
            continue
        if c in step[last]:
            # A text that starts again after an unknown letter walks what is there, or splits it off.
            q = step[last][c]
            if size[q] == size[last] + 1:
                last = q
                continue
            clone = len(size)
            size.append(size[last] + 1)
            step.append(dict(step[q]))
            link.append(link[q])
            link[q] = clone
            p = last
            while p != -1 and step[p].get(c) == q:
                step[p][c] = clone
                p = link[p]
            last = clone
            continue
        new = len(size)
        size.append(size[last] + 1)
        step.append({})
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                clone = len(size)
                size.append(size[p] + 1)
                step.append(dict(step[q]))
                link.append(link[q])
                link[q] = link[new] = clone
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = new
    return step


def phrases(moves: np.ndarray | Sparse, blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Greedy phrases of each block; blocks are rows, longest first, and all take a step at a time."""
    steps = moves if isinstance(moves, Sparse) else Table(moves.ravel(), moves.shape[1], moves.shape[0] - 1)
    start = steps.follow(np.zeros(steps.width, np.int64), np.arange(steps.width))
    start = np.where(start < 0, steps.dead, start).astype(np.int32)
    count = np.ones(len(blocks), dtype=np.int64)
    if not len(blocks):
        return count
    live = np.searchsorted(-sizes, -np.arange(blocks.shape[1]), side="left")
    state = start[blocks[:, 0]].astype(np.int64)
    for t in range(1, blocks.shape[1]):
        n = live[t]
        if not n:
            break
        c = blocks[:n, t].astype(np.int64)
        to = steps.follow(state[:n], c)
        miss = to < 0
        count[:n] += miss
        state[:n] = np.where(miss, start[c], to)
    return count


def parse(model: dict, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per symbol by document and language, and whether the document has a letter."""
    coded = [symbols(t, model["code"]) for t in batch]
    lettered = np.array([bool((c != SPACE).any()) for c in coded])
    owner, parts = [], []
    for i, c in enumerate(coded):
        if lettered[i]:
            for a in range(0, len(c), BLOCK):
                owner.append(i)
                parts.append(c[a : a + BLOCK])
    bits = np.zeros((len(batch), len(model["moves"])))
    if not parts:
        return bits, lettered
    sizes = np.array([len(p) for p in parts])
    order = np.argsort(-sizes, kind="stable")
    sizes, owner = sizes[order], np.array(owner)[order]
    blocks = np.zeros((len(parts), int(sizes[0])), dtype=model["code"].dtype)
    for row, k in enumerate(order):
        blocks[row, : sizes[row]] = parts[k]
    length = np.maximum(1, np.bincount(owner, sizes, len(batch)))
    for j, moves in enumerate(model["moves"]):
        own = model["letters"][j][blocks]
        bits[:, j] = np.bincount(owner, phrases(moves, own, sizes), len(batch)) * np.log2(model["sizes"][j]) / length
    return bits, lettered


def spread(text: Column) -> Column:
    """A text of up to ``SAMPLE_CHARS`` whole, of a longer one as many characters from places spread over it."""
    size = SAMPLE_CHARS // PLACES
    left = F.length(text) - size
    parts = [F.substring(text, F.floor(left * k / (PLACES - 1)).cast("int") + 1, F.lit(size)) for k in range(PLACES)]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *parts))


def quotas(sizes: list[int], room: int) -> list[int]:
    """How many symbols each sequence gives: the same number each, and what short ones leave goes to the longer ones."""
    out = [0] * len(sizes)
    for done, k in enumerate(sorted(range(len(sizes)), key=lambda k: sizes[k])):
        out[k] = min(sizes[k], room // (len(sizes) - done))
        room -= out[k]
    return out


def cut(found: np.ndarray, quota: int, k: int) -> np.ndarray:
    """About ``quota`` symbols of the k-th sequence, from places spread over it; one place alone is another one in each row."""
    if len(found) <= quota:
        return found
    places = max(1, min(PLACES, quota // PLACE_SYMBOLS))
    size = quota // places
    at = np.linspace(0, len(found) - size, places) if places > 1 else [(len(found) - size) * (k % PLACES) / (PLACES - 1)]
    return np.concatenate([found[int(a) : int(a) + size] for a in at])


def shared_room(sequences: list[np.ndarray], room: int) -> np.ndarray:
    """Up to ``room`` symbols of the sequences together."""
    share = quotas([len(x) for x in sequences], room)
    return np.concatenate([cut(x, share[k], k) for k, x in enumerate(sequences)])


def chosen_rows(labelled: DataFrame) -> DataFrame:
    """``lang``, ``mark`` and ``rank`` of the ``SAMPLE_ROWS`` smallest text hashes of each language.

    The number of different hashes of a language, about, gives a bound that lets some ``MARGIN`` times as many through, so no task
    ranks a whole language.
    """
    counted = labelled.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n"))
    bound = F.when(F.col("n") <= MARGIN * SAMPLE_ROWS, F.lit(float(1 << 63))).otherwise(F.lit(2.0**64) * MARGIN * SAMPLE_ROWS / F.col("n") - F.lit(2.0**63))
    near = labelled.join(F.broadcast(counted.select("lang", bound.alias("bound"))), "lang")  # a row a language
    few = near.where(F.col("mark").cast("double") <= F.col("bound")).select("lang", "mark").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    return few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS).select("lang", "mark", "rank")


def fit(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text") -> dict:
    """Automata from the rows where ``learn`` holds: per language the rows with the smallest text hash.

    Texts become symbols and are cut inside the tasks; at most ``SAMPLE_SYMBOLS`` symbols a language and ``ALL_SYMBOLS`` of
    all reach the driver.
    """
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    # Hashes are ranked without their texts; then the chosen texts are fetched.
    rows_of = labelled.join(F.broadcast(chosen_rows(labelled)), ["lang", "mark"])  # SAMPLE_ROWS marks per language
    sample = rows_of.select("lang", "rank", spread(F.col("text")).alias("text")).groupBy("lang", "rank").agg(F.min("text").alias("text"))

    def encode():
        table = letter_points()

        def work(batch: pa.RecordBatch) -> dict:
            found = [symbols(t, table) for t in batch.column(2).to_pylist()]
            return {"lang": batch.column(0), "rank": batch.column(1), "found": pa.array(found, pa.list_(pa.int32()))}

        return work

    coded = stored(map_rows(sample, encode, "lang string, rank int, found array<int>"), "language-sample")
    sizes: dict[str, dict[int, int]] = {}
    for lang, rank, size in coded.select("lang", "rank", F.size("found")).collect():  # at most SAMPLE_ROWS short rows a language
        sizes.setdefault(lang, {})[rank] = size
    room = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, len(sizes)))
    share = {(lang, rank): quota for lang, by in sizes.items() for rank, quota in zip(sorted(by), quotas([by[r] for r in sorted(by)], room), strict=True)}

    def shorten():
        def work(batch: pa.RecordBatch) -> dict:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            found = [cut(batch.column(2)[i].values.to_numpy(), share[k], k[1] - 1) for i, k in enumerate(keys)]
            return {"lang": batch.column(0), "rank": batch.column(1), "found": pa.array(found, pa.list_(pa.int32()))}

        return work

    parts: dict[str, dict[int, np.ndarray]] = {}
    for lang, rank, found in map_rows(coded, shorten, "lang string, rank int, found array<int>").toLocalIterator():
        parts.setdefault(lang, {})[rank] = np.array(found, dtype=np.int32)
    points = letter_points()
    sequences = {lang: np.concatenate([parts[lang][r] for r in sorted(parts[lang])]) for lang in sorted(parts)}
    sequences = {lang: found for lang, found in sequences.items() if not (found == SPACE).all()}
    letters = {lang: np.unique(found[found != SPACE]) for lang, found in sequences.items()}
    known = np.unique(np.concatenate([np.zeros(0, np.int32), *letters.values()]))
    code = letter_codes(points, known)
    model: dict = {"code": code, "names": [], "letters": [], "moves": [], "sizes": []}
    for lang, sequence in sequences.items():
        # The language's own symbols: letters it does not have are unknown to it.
        own = np.zeros(len(known) + 2, dtype=np.min_scalar_type(len(letters[lang]) + 1))
        own[SPACE] = SPACE
        own[code[letters[lang]]] = np.arange(2, len(letters[lang]) + 2)
        model["names"].append(lang)
        model["letters"].append(own)
        model["moves"].append(suffix_automaton(own[code[sequence]], len(letters[lang]) + 2))
        model["sizes"].append(max(2, len(sequence)))
    return model


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = texts(docs, id_col, text_col)

    def make():
        label = labeller(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            names, scores = label(batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": scores}

        return work

    return map_rows(narrow, make, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def labeller(model: dict):
    def label(batch: list[str]) -> tuple[list[str], np.ndarray]:
        if not model["names"]:
            return ["und"] * len(batch), np.zeros(len(batch))
        bits, lettered = parse(model, batch)
        best = bits.argmin(axis=1)
        lead = np.exp2(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)))
        score = np.where(lettered, 1 / lead.sum(axis=1), 0.0)
        return [model["names"][k] if ok else "und" for k, ok in zip(best, lettered, strict=True)], score

    return label


def predicted(docs: DataFrame, model: dict, text_col: str, name: str) -> DataFrame:
    """The rows themselves with the prediction as one more column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    at, names = docs.columns.index(text_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labeller(shared.value)
        for batch in rows(batches):
            found = label(pc.fill_null(batch.column(at).cast(pa.string()), "").to_pylist())[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=names)

    return docs.mapInArrow(run, schema)
