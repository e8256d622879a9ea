"""Raw inputs with explicit schemas; land once as parquet, read parquet afterwards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapwright.functions.values import to_double, to_int
from mapwright.sources.storage import scratch_folder

#: What stands between the objects of a file.
BETWEEN = " \t\r\n,[]\ufeff"
#: A JSON text, and what is left of one that is open.
TEXT = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
TEXT_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)
SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("before", pa.bool_()), ("after", pa.bool_()), ("change", pa.int64()), ("least", pa.int64())])
RECORDS = pa.schema([("file", pa.string()), ("record", pa.string()), ("block", pa.int64()), ("began", pa.int64())])

# Columns of the raw files.
MOVIES = "movieId int, title string, genres string"
RATINGS = "movieId int, rating double"
TAGS = "movieId int, tag string"
ARTISTS = (
    "mbid string, artist_lastfm string, artist_mb string, country_lastfm string, country_mb string, "
    "tags_lastfm string, listeners_lastfm bigint, scrobbles_lastfm bigint, ambiguous_artist boolean")
BUSINESS = (
    "business_id string, name string, categories string, stars double, review_count int, address string, "
    "city string, latitude double, longitude double")
REVIEW = (
    "review_id string, business_id string, text string, date string, stars double, useful int, funny int, cool int")
TIP = "business_id string, text string"
RAW_MOVIE_REVIEW = (
    "review_id string, reviewer string, movie string, rating string, review_summary string, review_date string, "
    "spoiler_tag int, review_detail string, helpful array<string>")


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Header CSV bound by column name, whatever the order of the columns; NaN and unreadable numbers become null.

    The files of one path share a header. Files stay splittable unless ``multi_line`` says that quoted fields may hold
    line breaks. A column of the schema that no file has is an error.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    wanted = T.StructType.fromDDL(schema)
    missing = [f.name for f in wanted if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")

    def typed(field: T.StructField) -> Column:
        c = raw[field.name]
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return to_double(c).cast(field.dataType)
        return c if isinstance(field.dataType, T.StringType) else F.trim(c).try_cast(field.dataType)

    return raw.select(*[typed(f).alias(f.name) for f in wanted])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def after_piece(piece: str, in_text: bool) -> tuple[int, bool]:
    """What a piece and the closing brace behind it do to the depth of objects, and whether a text is open after them."""
    if in_text:
        inside = TEXT_END.match(piece)
        if not inside:
            return 0, True
        piece = piece[inside.end():]
    bare = TEXT.sub("", piece)
    quote = bare.find('"')
    return (bare.count("{") - 1, False) if quote < 0 else (bare.count("{", 0, quote), True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Pieces by file and split, a batch at a time, in order."""
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        for (file, block), rows in groupby(keys, key=lambda r: r[:2]):
            yield file, block, [r[2] for r in rows]


def _split_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split and state (a text open before it or not): change of depth, least depth outside texts, state after."""
    for (file, block), runs in groupby(_runs(batches), key=lambda r: r[:2]):
        states = [[False, 0, 1], [True, 0, 1]]  # a text is open, depth so far, least depth at a closing brace
        for _, _, pieces in runs:
            for piece in pieces:
                for state in states:
                    change, state[0] = after_piece(piece, state[0])
                    state[1] += change
                    if not state[0]:
                        state[2] = min(state[2], state[1])
        rows = [{"file": file, "block": block, "before": before, "after": s[0], "change": s[1], "least": s[2]} for before, s in zip((False, True), states, strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=SUMMARY)


def split_states(rows: list[tuple]) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """State at the beginning of every split: a text is open, the depth, and the split in which the open object began.

    Rows: file, block, before, after, change, least. A file that ends inside an object is an error.
    """
    out = {}
    for file, mine in groupby(sorted(rows), key=lambda r: r[0]):
        in_text, depth, began = False, 0, -1
        for block, both in groupby(mine, key=lambda r: r[1]):
            if depth < 0:
                raise ValueError(f"{file} holds something else than objects: a brace too many")
            _, _, _, after, change, least = next(r for r in both if r[2] == in_text)
            out[file, block] = (in_text, depth, began)
            if (not depth and not in_text) or depth + least <= 0:
                began = block
            in_text, depth = after, depth + change
        if in_text or depth > 0:
            raise ValueError(f"{file} ends inside an object")
    return out


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Every object of files that hold an array of objects, objects one after another, or both: ``file`` and ``record``.

    Files are read twice in splits, as pieces that end at a closing brace. The first reading sums up each split for both
    states it may begin in (inside a text or not); following these rows, one or two a split, gives the state in which each
    split does begin. The second cuts the objects in all splits at once; an object over a border leaves parts that
    are put together by the split in which it began. Runs at once and stores the objects; a task holds one object.
    """
    pieces = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    found = pieces.mapInArrow(_split_summaries, "file string, block bigint, before boolean, after boolean, change bigint, least bigint")
    states = spark.sparkContext.broadcast(split_states([tuple(r) for r in found.collect()]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), runs in groupby(_runs(batches), key=lambda r: r[:2]):
            in_text, depth, began = states.value[file, block]
            open_, rows = [], []  # pieces of the object that is being read
            first, ended = depth > 0 or in_text, False
            for _, _, pieces in runs:
                for piece in pieces:
                    if ended:
                        raise ValueError(f"{file} holds something else than objects: a brace too many")
                    if not depth and not in_text and not piece.strip(BETWEEN):
                        ended = True  # what follows the last object of a file
                        continue
                    change, in_text = after_piece(piece, in_text)
                    depth += change
                    open_.append(piece + "}")
                    if depth <= 0 and not in_text:
                        text = "".join(open_)
                        rows.append((file, text if first else text.lstrip(BETWEEN), block, began if first else None))
                        if depth < 0 or not (first or rows[-1][1].startswith("{")):
                            raise ValueError(f"{file} holds something else than objects: {text[:80]}")
                        open_, first = [], False
                yield _records(rows)
                rows = []
            if open_:
                text = "".join(open_)
                yield _records([(file, text if first else text.lstrip(BETWEEN), block, began if first else block)])

    stored = scratch_folder(spark, "records")
    pieces.mapInArrow(cut, "file string, record string, block bigint, began bigint").write.parquet(stored)
    parts = spark.read.schema("file string, record string, block bigint, began bigint").parquet(stored)
    in_order = F.array_sort(F.collect_list(F.struct("block", "record")))
    over = parts.where("began IS NOT NULL").groupBy("file", "began").agg(F.array_join(F.transform(in_order, lambda p: p["record"]), "").alias("record"))
    return parts.where("began IS NULL").select("file", "record").unionByName(over.select("file", "record"))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS, strict=True)], schema=RECORDS)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of arrays or of objects one after another, with the columns of the schema."""
    return json_records(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")


def land(df: DataFrame, path: str) -> DataFrame:
    """Store a raw input as parquet and read it back from there."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def _first_path(df: DataFrame, paths: list[str]) -> Column:
    """First of the nested fields that exists and is not null."""
    found = []
    for path in paths:
        kind, ok = df.schema, True
        for part in path.split("."):
            names = kind.fieldNames() if hasattr(kind, "fieldNames") else []
            if part not in names:
                ok = False
                break
            kind = kind[part].dataType
        if ok:
            found.append(F.col(path))
    return F.coalesce(*[to_int(c) for c in found]).cast("int") if found else F.lit(None).cast("int")


def read_map_items(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Exported map items, from lines, a list, or an object that wraps the list, with the
    cluster wherever the export put it."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(path, multiLine=True) if schema is None else reader.json(path)
    for wrapper in ("atlas", "nodes", "items"):
        if wrapper in df.columns:
            df = df.select(F.explode(wrapper).alias("item")).select("item.*")
            break
    # Places the cluster number may stand in.
    cluster = _first_path(df, ["cluster", "visual.cluster", "visual.cluster_id", "region.cluster", "region.id"])
    return df.withColumn("cluster_id", cluster)
