"""Stored batches that are merged by generation.

A batch is written as a part of generation 0. When ``fan`` parts of a generation are full, one merge writes them as one
part of the next. After ``n`` batches at most ``fan - 1`` parts of each generation are live, so a reader meets about
``fan * log(n)`` folders, and a row is written again once a generation. Which parts are merged follows from the batch's
number alone: a repeated batch writes the same folders again.

A pointer, one row, is written after the merges of a batch. What a merge has taken up is removed ``fan`` batches later, so
readers that started from an older pointer can finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8


def live_parts(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Generation and number of the parts that hold the first ``batches`` batches, oldest first."""
    parts, start, size, generation = [], 0, 1, 0
    while size * fan <= batches:
        size, generation = size * fan, generation + 1
    while start < batches:
        while start + size > batches:
            size, generation = size // fan, generation - 1
        parts.append((generation, start // size))
        start += size
    return parts


def merges(number: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Generation and number of the parts that batch ``number`` completes, lowest generation first."""
    done, size, generation = [], fan, 1
    while (number + 1) % size == 0:
        done.append((generation, (number + 1) // size - 1))
        size, generation = size * fan, generation + 1
    return done


def _folder(path: str, generation: int, part: int) -> str:
    return f"{path}/generation-{generation}/{part}"


def _remove(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def add_batch(batch: DataFrame, number: int, path: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
    """Store a batch and the merges it completes; what was merged ``fan`` batches ago is removed."""
    spark = batch.sparkSession
    old = number - fan
    if old >= 0:
        for generation, part in merges(old, fan):
            for k in range(fan):
                _remove(spark, _folder(path, generation - 1, part * fan + k))
        _remove(spark, f"{path}/pointer/at={old}")
    batch.write.mode("overwrite").parquet(_folder(path, 0, number))
    for generation, part in merges(number, fan):
        parts = [_folder(path, generation - 1, part * fan + k) for k in range(fan)]
        merge(spark.read.parquet(*parts)).write.mode("overwrite").parquet(_folder(path, generation, part))
    spark.range(1).select(F.lit(number + 1).alias("batches")).write.mode("overwrite").parquet(f"{path}/pointer/at={number}")


def stored_rows(spark: SparkSession, path: str, fan: int = FAN, batches: int | None = None) -> DataFrame:
    """The rows of all live parts, or of those of the first ``batches`` batches; ``merge`` over them gives the state.

    An older number of batches can be asked for as long as its parts are kept, ``fan`` batches at least.
    """
    if batches is None:
        batches = spark.read.parquet(f"{path}/pointer").agg(F.max("batches")).first()[0]
    return spark.read.parquet(*[_folder(path, *part) for part in live_parts(batches, fan)])
