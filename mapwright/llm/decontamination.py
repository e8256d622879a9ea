"""Benchmark passages in documents, found by template windows, also when numbers, names or units were exchanged.

A text becomes template tokens: numbers, units and names (capitalised words inside a sentence) are typed placeholders, all
else is the lower-cased word. Windows of ``WINDOW`` tokens with at least ``LITERALS`` plain words are hashed; those with names a
second time with the names as words. Documents keep only
windows that pass a bitmap of the benchmark's windows (of fixed size, whatever the benchmark's), and these meet the benchmark
in a hash join. The exchanged values must be consistent: one value of the item stands for one value of the document. A pair
counts when enough of the item's windows are found with consistent values, in the whole document or in one occurrence:
windows of the same distance from their places in the item (or of almost the same, for inserted words), or windows that hold
the item's own values.

Items shorter than a window are one window of their own length, and documents are cut into windows of these lengths too. An item
without a window of enough plain words (short ones, numbers) is found by its own words: windows of all words as they are, kept
where the passage of the document is the item's but for capitals and white space. Letters of scripts written without spaces
are words of their own. Null or empty texts and items have no windows; nor have texts without any letter or digit. Repeated documents are each reported; rows that share a ``doc_id`` are one document. An empty table on either side
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapwright.llm.common import Recent, free_name, has_bit, map_rows, set_bits, small_batches, stored, texts

WINDOW, LITERALS = 8, 5
#: A pair counts with this share of the item's windows, or with this many of them.
SHARE, ENOUGH = 0.5, 6
#: Share of the item's exchanged values that must map to one value each.
CONSISTENT = 0.75
#: Windows of one occurrence differ by at most so many words, from one to the next, in their distance from the item's places.
DRIFT = 4
BITS = 1 << 25
VIEW = "struct<kind:int,piece:bigint,at:bigint>"
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|\w+|[.!?\n]")
# Thai, Lao, Tibetan, Myanmar, Khmer, Tai Le to Khmer signs, Kana and Bopomofo, Han, and their higher planes.
SPACELESS = "\u0e01-\u0e4f\u0e81-\u0ecf\u0edc-\u0fbc\u1000-\u103f\u1050-\u109f\u1780-\u17d3\u1950-\u19df\u3005-\u3007\u3021-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00016fe0-\U00018dff\U0001b000-\U0001b2ff\U00020000-\U0003ffff"
HAS_SPACELESS = re.compile(f"[{SPACELESS}]")
TOKEN_SPACELESS = re.compile(rf"\d+(?:[.,]\d+)*|[{SPACELESS}]|[^\W{SPACELESS}]+|[.!?\n]")
LITERAL, NUMBER, UNIT, NAME, MARK = range(5)

# Words that count as units.
UNITS = {
    "mm", "cm", "dm", "km", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mi", "mile", "miles",
    "mg", "kg", "gram", "grams", "kilogram", "kilograms", "oz", "ounce", "ounces", "lb", "lbs", "pound", "pounds", "ton", "tons",
    "ml", "cl", "liter", "liters", "litre", "litres", "gallon", "gallons", "sec", "second", "seconds", "minute",
    "minutes", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre",
    "metres", "kilometer", "kilometers", "kilometre", "kilometres", "centimeter", "centimeters", "mph", "kmh", "dollar", "dollars", "euro",
    "euros", "cent", "cents", "percent", "usd", "eur",
}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code(token: str) -> int:
    """The token's hash, with its kind in the lowest three bits."""
    lowered = token.lower()
    if token in ".!?\n":
        kind = MARK
    elif token[0].isdigit():
        kind = NUMBER
    elif lowered in UNITS:
        kind = UNIT
    elif len(token) > 1 and token[0].isupper() and token[1:].islower():
        kind = NAME
    else:
        kind = LITERAL
    data = lowered.encode("utf-8", "replace")
    return (zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)) & ~7 | kind


def pattern(text: str) -> re.Pattern:
    return TOKEN if text.isascii() or not HAS_SPACELESS.search(text) else TOKEN_SPACELESS


def template(text: str, codes: Recent) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, the places of the words among them, the words' kinds and their hashes as plain words."""
    tokens = pattern(text).findall(text)
    coded = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    kind = (coded & np.uint64(7)).astype(np.int8)
    mark = kind == MARK
    opens = np.concatenate(([True], mark[:-1])) if len(tokens) else mark
    kind[(kind == NAME) & opens] = LITERAL
    return tokens, np.flatnonzero(~mark), kind[~mark], coded[~mark] & ~np.uint64(7)


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` words."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mixed(total + np.uint64(width))


def windows(kind: np.ndarray, words: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts and hashes of the windows with enough plain words, with the kinds they were made from.

    Windows that hold names come twice: with placeholders, and with the names as plain words, so that a passage set in
    other capitals is found too. Only a text that is one window may have fewer plain words, if all its words are.
    """
    n = len(words) - width + 1
    out = []
    if n < 1 or not width or width < LITERALS and n > 1:
        return out
    for names in (True, False):
        own = kind if names else np.where(kind == NAME, LITERAL, kind)
        if not names and not (kind == NAME).any():
            continue
        hashes = mixed(np.where(own == LITERAL, words, own.astype(np.uint64) + np.uint64(1)))
        plain = np.concatenate(([0], np.cumsum(own == LITERAL)))
        good = plain[width:] - plain[:n] >= min(LITERALS, width)
        if not names:
            named = np.concatenate(([0], np.cumsum(kind == NAME)))
            good &= named[width:] > named[:n]
        at = np.flatnonzero(good)
        out.append((at, rolled(hashes, width)[at], own))
    return out


def verbatim(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of words as they are, whatever their kinds."""
    return rolled(mixed(words + np.uint64(MARK)), width)


def passages(text: str, places: np.ndarray, starts: list[int], width: int) -> list[int]:
    """Digests of the passages that begin at these words, in lower case and with single spaces."""
    spans = [m.span() for m in pattern(text).finditer(text)]
    return [digest(" ".join(text[spans[places[a]][0] : spans[places[a + width - 1]][1]].lower().split())) for a in starts]


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def slots(tokens: list[str], places: np.ndarray, kind: np.ndarray, at: int, width: int) -> list[str]:
    return [tokens[places[i]].lower() for i in range(at, at + width) if kind[i] != LITERAL]


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``item_at``, ``window``, ``item_slots`` and ``n_windows`` of the item.

    ``width`` is the window's; ``sign`` is what documents are tried by: the window, or a verbatim window's words.
    """
    narrow = benchmark.select(benchmark[item_col].alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())

    def make():
        codes = Recent(code)

        def work(batch: pa.RecordBatch) -> dict:
            ids, starts, values, held, counts, widths, signs, forms = [], [], [], [], [], [], [], []

            def add(item, at, window, own_slots, number, width, sign, exact):
                ids.append(item), starts.append(at), values.append(window), held.append(own_slots)
                counts.append(number), widths.append(width), signs.append(sign), forms.append(exact)

            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, places, kind, words = template(text, codes)
                width = min(WINDOW, len(words))
                made = windows(kind, words, width)
                number = len(np.unique(np.concatenate([at for at, _, _ in made]))) if made else 0
                for at, found, own in made:
                    for a, w in zip(at.tolist(), found.astype(np.int64).tolist(), strict=True):
                        add(item, a, w, slots(tokens, places, own, a, width), number, width, w, False)
                if width and (not number or width < LITERALS):
                    found = verbatim(words, width).astype(np.int64).tolist()
                    for a, (sign, w) in enumerate(zip(found, passages(text, places, range(len(found)), width), strict=True)):
                        add(item, a, w, [], len(found), width, sign, True)
            return {
                "item_id": pa.array(ids, batch.column(0).type), "item_at": pa.array(starts, pa.int64()), "window": pa.array(values, pa.int64()), "item_slots": pa.array(held, pa.list_(pa.string())),
                "n_windows": pa.array(counts, pa.int64()), "width": pa.array(widths, pa.int32()), "sign": pa.array(signs, pa.int64()), "exact": pa.array(forms, pa.bool_()),
            }

        return work

    return map_rows(narrow, make, f"item_id {narrow.schema['item_id'].dataType.simpleString()}, item_at long, window long, item_slots array<string>, n_windows long, width int, sign long, exact boolean")


def document_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece`` (the text's digest), ``window``, ``doc_slots`` and all places ``doc_at`` of the windows that may be an item's."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(set_bits(items.select(F.pmod("sign", F.lit(BITS)).alias("place")), BITS))
    shapes = sorted(map(tuple, items.select("width", "exact").distinct().collect()))  # at most WINDOW widths, twice
    narrow = texts(docs, id_col, text_col).where("doc_id is not null")

    def make():
        codes = Recent(code)
        bitmap = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            row, pieces, values, held, places_of = [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                tokens, places, kind, words = template(text, codes)
                met: dict[tuple, list[int]] = {}
                for width, exact in shapes:
                    if exact:
                        hit = np.flatnonzero(has_bit(bitmap, (verbatim(words, width) & np.uint64(BITS - 1)).astype(np.int64))).tolist()
                        for a, w in zip(hit, passages(text, places, hit, width) if hit else [], strict=True):
                            met.setdefault((w,), []).append(a)
                        continue
                    for at, found, own in windows(kind, words, width):
                        hit = has_bit(bitmap, (found & np.uint64(BITS - 1)).astype(np.int64))
                        for a, w in zip(at[hit].tolist(), found[hit].astype(np.int64).tolist(), strict=True):
                            met.setdefault((w, *slots(tokens, places, own, a, width)), []).append(a)
                piece = digest(text) if met else 0
                for (w, *own_slots), starts in met.items():
                    row.append(r), pieces.append(piece), values.append(w), held.append(own_slots), places_of.append(starts)
            return {
                "doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(pieces, pa.int64()), "window": pa.array(values, pa.int64()),
                "doc_slots": pa.array(held, pa.list_(pa.string())), "doc_at": pa.array(places_of, pa.list_(pa.int64())),
            }

        return work

    return map_rows(narrow, make, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece long, window long, doc_slots array<string>, doc_at array<bigint>")


def consistency(met: DataFrame, *by: str) -> DataFrame:
    """Per document, item and ``by``: windows found, the item's windows, exchanged values and how many are consistent."""
    keys = ["doc_id", "item_id", *by]
    pair = F.explode_outer(F.arrays_zip("item_slots", "doc_slots"))
    # Per exchanged value of the item: does it stand for one value of the document?
    values = met.select(*keys, "item_at", "n_windows", pair.alias("pair")).select(*keys, "item_at", "n_windows", "pair.*")
    per_value = values.groupBy(*keys, "item_slots").agg(
        F.count_distinct("doc_slots").alias("stands_for"), F.max(F.col("item_slots") != F.col("doc_slots")).alias("exchanged"),
        F.max("n_windows").alias("n_windows"), F.collect_set("item_at").alias("at"),
    )
    slot = F.col("item_slots").isNotNull()
    return per_value.groupBy(*keys).agg(
        F.max("n_windows").alias("item_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("windows_found"),
        F.sum(F.when(slot, 1).otherwise(0)).alias("slots"), F.sum(F.when(slot & (F.col("stands_for") == 1), 1).otherwise(0)).alias("consistent_slots"),
        F.coalesce(F.max("exchanged"), F.lit(False)).alias("exchanged"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item: windows found, the item's windows, exchanged values and how many are consistent.

    The figures are those of the whole document, or, if its values are not consistent, of the occurrence with most windows.
    """
    items = stored(item_windows(benchmark), "item-windows")
    found = stored(document_windows(docs, items, id_col, text_col).distinct(), "document-windows")
    met = found.join(items, "window").where(F.size("item_slots") == F.size("doc_slots"))
    enough = (F.col("windows_found") >= F.col("item_windows") * SHARE) | (F.col("windows_found") >= ENOUGH)
    consistent = F.col("consistent_slots") >= F.col("slots") * CONSISTENT
    whole = consistency(met).where(enough)
    unsure = whole.where(~consistent).select("doc_id", "item_id")
    # Occurrences: windows on one alignment, on alignments next to each other, and those with the item's own values.
    placed = met.join(unsure, ["doc_id", "item_id"]).withColumn("doc_at", F.explode("doc_at")).withColumn("place", F.col("doc_at") - F.col("item_at"))
    in_order = Window.partitionBy("doc_id", "piece", "item_id").orderBy("place")
    placed = placed.withColumn("jump", F.when(F.col("place") - F.lag("place").over(in_order) > DRIFT, 1).otherwise(0))
    placed = placed.withColumn("run", F.sum("jump").over(in_order))
    view = lambda kind, piece, at: F.struct(F.lit(kind).alias("kind"), piece.cast("long").alias("piece"), at.cast("long").alias("at"))
    aligned = F.array(view(0, F.col("piece"), F.col("place")), view(1, F.col("piece"), F.col("run")))
    own = F.when(F.col("item_slots") == F.col("doc_slots"), F.array(view(2, F.lit(0), F.lit(0)))).otherwise(F.array().cast(f"array<{VIEW}>"))
    occurrences = consistency(placed.withColumn("view", F.explode(F.concat(aligned, own))), "view").where(enough & consistent)
    figures = F.struct("windows_found", "item_windows", "consistent_slots", "slots", (~F.col("exchanged")).alias("own"))
    best = occurrences.groupBy("doc_id", "item_id").agg(F.max(figures).alias("best")).select("doc_id", "item_id", "best.*")
    best = best.withColumn("exchanged", ~F.col("own")).drop("own")
    return whole.where(consistent).unionByName(best)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    # By the text's digest: ids may repeat or be missing.
    key, bad_key = free_name(docs.columns, "text_digest"), free_name(docs.columns, "bad_digest")
    keyed = docs.withColumn(key, F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    bad = contaminated(keyed.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")), benchmark).select(F.col("doc_id").alias(bad_key)).distinct()
    return keyed.join(bad, keyed[key] == bad[bad_key], "left_anti").select(*docs.columns)
