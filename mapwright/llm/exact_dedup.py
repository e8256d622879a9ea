"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then the full hash.

Texts are equal when they are identical after A-Z are lower-cased. Each round counts keys in Spark and keeps what repeats
as a bitmap of fixed size, so the next round reads content only where the cheaper key repeats. A bit that two keys share
only lets a row through to the next round; the last round compares SHA-256 of whole texts.

Null texts count as empty. Rows with the same id and text are copies too: one of them stays. A null id is smaller than any
id. An empty table gives an empty result. Columns the operator adds replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapwright.llm.common import free_name, has_bit, rows, set_bits, small_batches, stored

#: Bits of the maps of repeated lengths and of repeated (length, beginning) keys; 0.5 MB and 4 MB whatever the input.
LENGTH_BITS, PREFIX_BITS = 1 << 22, 1 << 25
PREFIX_CHARS = 64
# The letters that are compared without case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slot(bits: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def repeated(keyed: DataFrame, keys: list[str], bits: int) -> np.ndarray:
    """Bitmap of the slots of keys that more than one row has; at most ``bits / 8`` bytes reach the driver."""
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return set_bits(counted.select(slot(bits, *[F.col(k) for k in keys]).alias("place")), bits)


def full_hashes(docs: DataFrame, text_col: str, everywhere: bool) -> tuple[DataFrame, str, str]:
    """The rows with two more columns: SHA-256 of the normalised text and whether another row may have the same text.

    Content is read where the length and the beginning repeat; ``everywhere`` asks for the hash of the other rows too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sha, survived, place = (free_name(docs.columns, n) for n in ("sha", "survived", "place"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    size = F.octet_length(text)
    head = F.translate(F.substring(text, 1, PREFIX_CHARS), UPPER, LOWER)
    lengths = spark.sparkContext.broadcast(repeated(docs.select(size.alias("size")), ["size"], LENGTH_BITS))
    sized = docs.select(size.alias("size"), head.alias("head"))

    def same_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(lengths.value, batch.column(2).to_numpy())))

    narrowed = sized.select("size", F.xxhash64("head").alias("head"), slot(LENGTH_BITS, F.col("size")).alias("at")).mapInArrow(same_length, "size int, head long, at long")
    heads = spark.sparkContext.broadcast(repeated(narrowed, ["size", "head"], PREFIX_BITS))
    keyed = docs.select(
        *[docs[c] for c in docs.columns],
        F.struct(slot(LENGTH_BITS, size), slot(PREFIX_BITS, size, F.xxhash64(head))).alias(place),
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(sha, T.BinaryType()), T.StructField(survived, T.BooleanType())])
    at, n = docs.columns.index(text_col), len(docs.columns)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            by_length, by_head = (batch.column(n).field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            alive = has_bit(lengths.value, by_length) & has_bit(heads.value, by_head)
            lowered = pc.ascii_lower(batch.column(at).cast(pa.string()))
            values = lowered.cast(pa.binary())
            digests = [hashlib.sha256(values[i].as_buffer() or b"").digest() if everywhere or alive[i] else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(digests, pa.binary()), pa.array(alive)], names=schema.names)

    return keyed.mapInArrow(hashed, schema), sha, survived


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, ``keep_id``, ``group_size``, ``kept`` and the hash of its normalised text."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    hashed, sha, survived = full_hashes(narrow, "text", everywhere=True)
    hashed = stored(hashed.select("doc_id", sha, survived), "exact-hashes")
    groups = hashed.where(survived).groupBy(sha).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    alone = hashed.where(~F.col(survived)).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    # Only rows that share both hash and id are numbered, so a large group is not one window.
    first = F.row_number().over(Window.partitionBy(sha, "doc_id").orderBy("doc_id")) == 1
    member = hashed.where(survived).withColumn("first", first).join(groups, sha)
    grouped = member.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first")).alias("kept"), sha)
    return alone.unionByName(grouped).withColumnRenamed(sha, "sha")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all their columns unchanged: of equal texts the one with the largest id."""
    hashed, sha, survived = full_hashes(docs, text_col, everywhere=False)
    keep, size = free_name(hashed.columns, "keep"), free_name(hashed.columns, "size")
    groups = hashed.where(survived).groupBy(F.col(sha).alias(size)).agg(F.max(id_col).alias(keep))
    # The id is part of the key: only the row that stays meets its group, so a hot text is spread over tasks.
    found = hashed.where(survived).join(groups, (F.col(sha) == F.col(size)) & F.col(id_col).eqNullSafe(F.col(keep)), "left_semi")
    found = found.dropDuplicates([sha, id_col])
    return hashed.where(~F.col(survived)).unionByName(found).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document of the table, dropped ones too."""
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
