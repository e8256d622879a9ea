"""Token counts by a two-tier lookup of pre-token lengths on the map side.

The first tier is a compact table of frequent pre-tokens and their token counts, broadcast once and of bounded size. A miss
goes to a cache in the worker and from there to the tokenizer's model. No pre-token is shuffled and every text is split whole, so
the table changes only the speed. Texts with characters outside the plain alphabet, or with a special token's string,
go to the tokenizer as they are.

Null texts count as empty: zero bytes and tokens. Repeated rows are counted each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import LETTERS, NOT_PLAIN, NUMBERS, SPACES, Recent, byte_level, lengths, map_rows, small_batches, texts

#: Pre-tokens in the broadcast table, the bytes one may have there, and the rows it is made from.
TABLE_SIZE, LONGEST, SAMPLE_ROWS = 1 << 15, 48, 2000
#: From this many characters on, pre-tokens are not put into a list first.
LONG_TEXT = 1 << 20

# The byte-level pre-token pattern, written for the plain alphabet.
PIECES = re.compile(
    f"\\x20?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|\\x20?[{NUMBERS}]+|\\x20?[^{SPACES}{LETTERS}{NUMBERS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    return [t.content for t in load(path).get_added_tokens_decoder().values()]


class Lengths(dict):
    """Frequent pre-tokens first, then this worker's cache, then the tokenizer's model."""

    def __init__(self, frequent: dict[str, int], encode: Callable[[str], int]):
        super().__init__(frequent)
        self.look = Recent(encode).__getitem__

    def __missing__(self, piece: str) -> int:
        return self.look(piece)


def frequent_pieces(docs: DataFrame, path: str, size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The compact table: pre-tokens one after another in UTF-8, their ends, and their token counts.

    Made from the ``sample_rows`` rows with the smallest hash of the text; at most ``size`` short pre-tokens.
    """
    # Hash and row number first: whole texts are then read only for the chosen hashes.
    mark = F.xxhash64("text")
    chosen = docs.select(mark.alias("mark")).orderBy("mark").limit(sample_rows).agg(F.max("mark")).first()[0]
    if chosen is None:
        return b"", np.zeros(0, np.uint32), np.zeros(0, np.uint16)

    def make():
        def count(batch: pa.RecordBatch) -> dict:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if not NOT_PLAIN.search(text):
                    counts.update(m.group() for m in PIECES.finditer(text) if m.end() - m.start() <= LONGEST)
            return {"piece": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())}

        return count

    counted = map_rows(docs.where(mark <= chosen).dropDuplicates(["text"]).select("text"), make, "piece string, n long")
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    pieces = [p for p, _ in top.collect() if len(p.encode()) <= LONGEST]
    tokens = [len(e.ids) for e in load(path).encode_batch(pieces, add_special_tokens=False)]
    coded = [p.encode() for p in pieces]
    return b"".join(coded), np.cumsum([len(c) for c in coded], dtype=np.uint32), np.array(tokens, dtype=np.uint16)


def expand(compact: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    joined, ends, tokens = compact
    starts = [0, *ends[:-1].tolist()]
    return {joined[a:b].decode(): n for a, b, n in zip(starts, ends.tolist(), tokens.tolist(), strict=False)}


def counter(path: str, frequent: dict[str, int]) -> Callable[[str], int]:
    """Token count of a whole text, equal to the tokenizer's own."""
    tokenizer = load(path)
    special = re.compile("|".join(map(re.escape, special_strings(path))) or "(?!)")
    whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    model = tokenizer.model
    look = Lengths(frequent, lambda piece: len(model.tokenize(byte_level(piece)))).__getitem__

    def count(text: str) -> int:
        # In ASCII texts all classes agree, control characters included.
        if not text.isascii() and NOT_PLAIN.search(text) or special.search(text):
            return whole(text)
        if len(text) > LONG_TEXT:
            return sum(look(m.group()) for m in PIECES.finditer(text))
        return sum(map(look, PIECES.findall(text)))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""
    small_batches(docs.sparkSession)
    docs = texts(docs, id_col, text_col)
    compact = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path))

    def make():
        count = counter(path, expand(compact.value))

        def work(batch: pa.RecordBatch) -> dict:
            found = np.fromiter(map(count, batch.column(1).to_pylist()), np.int64, batch.num_rows)
            return {"doc_id": batch.column(0), "n_bytes": lengths(batch.column(1)), "n_tokens": found, "over_limit": found > limit}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
