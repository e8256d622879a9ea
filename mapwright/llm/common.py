"""What the operators share: reading tables, stored intermediate results, text columns and plain alphabets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapwright.sources.storage import scratch_folder

#: Rows of whole texts that cross to Python at once, unless the session says otherwise.
ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; a value the session sets itself stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: later stages start from files any executor can reach."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, whatever else the table holds; a null text becomes empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


PAGE_BITS = 32768  # of Spark's bitmap functions


def set_bits(places: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the numbers in column ``place`` (0 to bits - 1); at most ``bits / 8`` bytes reach the driver."""
    place = F.col("place") + 1
    pages = places.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for page, found in pages.toLocalIterator():
        at = (page - 1) * PAGE_BITS // 8
        out[at : at + len(found)] = np.frombuffer(bytes(found), dtype=np.uint8)
    return out


def has_bit(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def id_bucket(column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number: the fixed split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def free_name(taken: Iterable[str], name: str) -> str:
    """A column name the table has not got yet, in any spelling."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def rows(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum((np.asarray(lengths(c)) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)), np.zeros(batch.num_rows, dtype=np.int64))
        starts, total = [0], 0
        for i, n in enumerate(sizes.tolist()):
            if total + n > limit and total:
                starts.append(i)
                total = 0
            total += n
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Each slice of rows to columns; ``make`` builds the worker's function once per task."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in rows(batches):
            work = work or make()
            out = work(batch)
            yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


class Recent(dict):
    """Cache of ``make(key)`` in two generations: what was not asked for during a whole generation is forgotten."""

    def __init__(self, make: Callable, size: int = 100_000, longest: int = 256):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


# The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order.
_PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def byte_level(piece: str) -> str:
    """A pre-token as the byte-level models see it."""
    if piece.isascii() and piece.isalpha():
        return piece
    return piece.encode().decode("latin-1").translate(BYTE_LEVEL)


# Character classes of the plain alphabet, in which Python's and the libraries' classes agree.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\\t\\n\\x0b\\x0c\\r\\x20"
#: Anything outside it sends a text to the tokenizer library as a whole.
NOT_PLAIN = re.compile("[^\\t\\n\\x0b\\x0c\\r -~¡-¬®-įı-ſ‐-‧€]")
