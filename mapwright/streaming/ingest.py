"""Incremental review ingest with Structured Streaming.

Sources are folders that receive files; progress, seen ids and sums live in the
checkpoint, so a run picks up where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mapwright.operators.ranking import top_per_group
from mapwright.streaming.generations import add_batch, stored_rows


def read_folder(spark: SparkSession, path: str, schema, files_per_batch: int = 8, pattern: str | None = None) -> DataFrame:
    """Stream of the parquet files a folder holds and receives."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def unique_reviews(stream: DataFrame, key: str = "review_id", time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Each id once over all batches. Without an event time every id seen stays in the
    state store; with one, ids older than ``delay`` are forgotten."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to parquet of all that has arrived, then stop."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start())


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def running_sums(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum and sum of squares per key, kept up to date batch by batch."""
    v = F.col(value)
    return stream.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
        F.min(v).alias("lowest"), F.max(v).alias("highest"))


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each key with the largest ``_batch``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def write_updates(sums: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Store the rows each batch changed; of merged batches the newest row of a key stays."""
    def save(batch: DataFrame, number: int) -> None:
        add_batch(batch.withColumn("_batch", F.lit(number)), number, path, lambda rows: newest(rows, keys))

    return (
        sums.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start())


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest stored row of every key."""
    return newest(stored_rows(spark, path), keys).drop("_batch")


def finish_sums(sums: DataFrame) -> DataFrame:
    """Mean and sample deviation from running sums; no deviation below two values."""
    n = F.col("n")
    spread = (F.col("squares") - F.col("total") * F.col("total") / n) / (n - 1)
    return sums.withColumn("mean", F.col("total") / n).withColumn(
        "std", F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))))


def keep_smallest(stream: DataFrame, entity: str, order: Sequence[Column], n: int, path: str, checkpoint: str) -> StreamingQuery:
    """Store the ``n`` first rows per entity of every batch while batches arrive.

    Batches are merged by generation, and a merge keeps ``n`` rows per entity again; ``smallest_rows`` joins what is live.
    """
    columns = stream.columns

    def first(rows: DataFrame) -> DataFrame:
        return top_per_group(rows, [entity], order, n, "_r").select(*columns)

    def save(batch: DataFrame, number: int) -> None:
        add_batch(first(batch), number, path, first)

    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def smallest_rows(spark: SparkSession, path: str, entity: str, order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` first rows per entity over all stored batches; each live part holds ``n`` per entity at most."""
    return top_per_group(stored_rows(spark, path), [entity], order, n, "_r").drop("_r")


def unique_since(stream: DataFrame, key: str, forget: str) -> DataFrame:
    """Each id once, for streams without an event time: an id is forgotten some time after it arrived.

    The time of arrival (of the batch, the same on a retry) serves as event time, so the state holds the ids of about
    twice ``forget``: an id that returns within ``forget`` is dropped, one that returns after twice that passes again.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", forget)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def count_arrivals(stream: DataFrame, key: str, valid: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Store each id once, and beside each batch how many rows were accepted, rejected and duplicates.

    ``valid`` tells which rows take part; rows without an id are rejected too. Ids and counts are kept under the batch's
    number and merged by generation. A batch meets the ids of the batches before it only, so one that is repeated after a
    stop gives the same rows and counts once. Which of several copies in one batch stays is not fixed. Counts are an
    aggregate of their own, since observed ones could count a task twice that ran again.
    """
    takes_part = F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull()

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.where(takes_part).dropDuplicates([key])
        if number > 0:
            first = first.join(stored_rows(spark, f"{path}/ids", batches=number), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        kept = spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={number}")
        add_batch(kept.select(key), number, f"{path}/ids", lambda ids: ids)
        seen = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(takes_part).alias("valid"))
        accepted = kept.agg(F.count(F.lit(1)).alias("accepted")).scalar()
        counts = seen.select(accepted.alias("accepted"), (F.col("rows") - F.col("valid")).alias("rejected"), (F.col("valid") - accepted).alias("duplicate"))
        add_batch(counts, number, f"{path}/counters", lambda rows: rows.agg(*[F.sum(k).alias(k) for k in COUNTS]))

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTS = ("accepted", "rejected", "duplicate")


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """One row: accepted, rejected and duplicate rows of all batches so far."""
    return stored_rows(spark, f"{path}/counters").agg(*[F.sum(k).alias(k) for k in COUNTS])


def windowed(stream: DataFrame, time: str, keys: Sequence[str], value: str, width: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Count and sum per key and event-time window, tumbling or sliding; state of a window goes ``delay`` after its end."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, keys: Sequence[str], value: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Count and sum per key and session: rows of a key less than ``gap`` apart. A session comes out once, when it is closed."""
    window = F.session_window(time, gap)
    return stream.withWatermark(time, delay).groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def keep_late(stream: DataFrame, time: str, width: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Store the rows that ``windowed`` with the same width and delay leaves out because their window is closed already.

    A window is closed for a batch if it ends ``delay`` or more before the latest time of the batches before. Each batch
    stores its late rows and the latest time so far under its number; a repeated batch replaces its own folders only.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.agg(F.max(time).alias("latest"))
        late = batch.where("false")
        if number > 0:
            before = spark.read.parquet(f"{path}/latest/batch={number - 1}")
            mark = before.select((F.col("latest") - F.expr(f"INTERVAL {delay}")).alias("_mark"))  # one row
            placed = batch.withColumn("_window", F.window(time, width)).join(F.broadcast(mark))
            late = placed.where("_window.end <= _mark").drop("_window", "_mark")
            latest = latest.unionByName(before).agg(F.max("latest").alias("latest"))
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        latest.write.mode("overwrite").parquet(f"{path}/latest/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
