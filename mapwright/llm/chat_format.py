"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\n text <|im_end|>\\n`` (without the blanks). Control strings inside a role or text are escaped
reversibly: ``<``, any backslashes and ``|`` get one backslash more, so ``<|`` stands only where the template puts it; in
a role, backslashes and line feeds are escaped too. For a slice of rows the lengths of all segments give their offsets by a
running sum, and headers and contents are scattered into one preallocated buffer that becomes the Arrow column.

Rows are dealt by conversation and sorted by turn, role and text inside tasks, and stream through: a conversation of any
size is a series of parts, each as large as a slice, in order. The loss mask is a list of code point ranges of the part.

A null role or text is empty; a null turn comes first; rows with a null ``conv_id`` form one conversation. Repeated rows stay
repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import rows, small_batches

START, END = "<|im_start|>", "<|im_end|>\n"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
#: Segments up to this many bytes are gathered by index, longer ones copied as blocks.
SHORT = 2048
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escape_role(column: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, with the start and length of each value."""
    column = pa.concat_arrays([column.cast(pa.string())])
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with every turn's bytes, and where each turn begins (with the end as the last)."""
    n = len(role)
    fixed = np.frombuffer((START + "\n" + END).encode(), dtype=np.uint8)
    (role_bytes, role_at, role_size), (text_bytes, text_at, text_size) = parts_of(role), parts_of(text)
    pools = np.concatenate([fixed, role_bytes, text_bytes])
    source, size = np.zeros((n, 5), np.int64), np.zeros((n, 5), np.int64)
    source[:, 0], size[:, 0] = 0, len(START)
    source[:, 1], size[:, 1] = role_at + len(fixed), role_size
    source[:, 2], size[:, 2] = len(START), 1
    source[:, 3], size[:, 3] = text_at + len(fixed) + len(role_bytes), text_size
    source[:, 4], size[:, 4] = len(START) + 1, len(END)
    source, size = source.ravel(), size.ravel()
    target = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(target[-1]), dtype=np.uint8)
    short = size <= SHORT
    within = np.arange(int(size[short].sum())) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
    out[np.repeat(target[:-1][short], size[short]) + within] = pools[np.repeat(source[short], size[short]) + within]
    for k in np.flatnonzero(~short):
        out[target[k] : target[k + 1]] = pools[source[k] : source[k] + size[k]]
    return out, target[::5]


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id``, ``part``, ``formatted``, ``loss_start``, ``loss_end``; a conversation's parts follow each other in order."""
    spark = turns.sparkSession
    small_batches(spark)
    kind = turns.schema["conv_id"].dataType.simpleString()
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ordered = narrow.repartition(number, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "part", "formatted", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, -1
        for batch in rows(batches):
            conv = batch.column(0)
            ids = conv.to_pylist()
            role, text = escape_role(batch.column(2).cast(pa.string())), escape(batch.column(3).cast(pa.string()))
            data, begin = assemble(role, text)
            chars = [pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (role, text)]
            turn_chars = len(START) + chars[0] + 1 + chars[1] + len(END)
            first = np.array([0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]])
            after = np.append(first[1:], len(ids))
            char_at = np.cumsum(turn_chars) - turn_chars
            text_from = char_at + len(START) + chars[0] + 1 - np.repeat(char_at[first], after - first)
            learned = pc.equal(role, LEARNED).to_numpy(zero_copy_only=False)
            kept = np.concatenate(([0], np.cumsum(learned)))
            list_at = pa.array(np.append(kept[first], kept[-1]).astype(np.int32))
            numbers = []
            for k in first.tolist():
                part = part + 1 if part >= 0 and ids[k] == last else 0
                last = ids[k]
                numbers.append(part)
            last = ids[-1]
            offsets = np.append(begin[first], begin[-1]).astype(np.int32)
            formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([
                conv.take(pa.array(first)), pa.array(numbers, pa.int64()), formatted,
                pa.ListArray.from_arrays(list_at, pa.array(text_from[learned])), pa.ListArray.from_arrays(list_at, pa.array((text_from + chars[1])[learned])),
            ], names=names)

    return ordered.mapInArrow(run, f"conv_id {kind}, part long, formatted string, loss_start array<long>, loss_end array<long>")


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, read back from the template."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn does not begin with its mark")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END)


class Digest:
    """Running figures of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in read_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for a, b in zip(starts, ends, strict=True):
            text = unescape(formatted[a:b])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)


def digest(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from the output of ``format_conversations`` as it streams out of the same task."""
    kind = formatted.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close():
            if state is not None:
                done.append((current, state.n_turns, state.turns.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.formatted_chars))

        for batch in batches:
            for conv, part, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    close()
                    current, state = conv, Digest()
                state.add(text, starts, ends)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        close()
        if done:
            yield batch_of(done)

    return formatted.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
