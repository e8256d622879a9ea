"""Checked queries: incremental ingest (Z rows), each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapwright.functions.values import sample_score
from mapwright.plans.registry import query, r6
from mapwright.sources import storage
from mapwright.sources.storage import scratch_folder
from mapwright.streaming import ingest


def stream_of(t, table):
    """The table as a stream, be it one file or a folder of them: a pattern that only its own name fits takes both."""
    return ingest.read_folder(t.spark, f"{t.sf_dir}/{{{table}.parquet}}", t.base(table).schema)


@query("z01_streamed_dedupe", "SELECT DISTINCT md5(text) AS review_id, CAST(length(text) AS INTEGER) AS chars FROM documents")
def z01(t):
    base = scratch_folder(t.spark, "dedupe")
    stream = stream_of(t, "documents").select(F.md5("text").alias("review_id"), F.length("text").alias("chars"))
    ingest.run_to_end(ingest.append_to(ingest.unique_reviews(stream), f"{base}/out", f"{base}/progress"))
    return t.spark.read.parquet(f"{base}/out")


@query("z01_dedupe_with_watermark", "SELECT event_id, user_id FROM events")
def z01_time(t):
    base = scratch_folder(t.spark, "watermark")
    stream = stream_of(t, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    unique = ingest.unique_reviews(stream, "event_id", "ts", "60 days").select("event_id", "user_id")
    ingest.run_to_end(ingest.append_to(unique, f"{base}/out", f"{base}/progress"))
    return t.spark.read.parquet(f"{base}/out")


@query("z01_dedupe_with_time_to_live", "SELECT DISTINCT md5(text) AS review_id, CAST(length(text) AS INTEGER) AS chars FROM documents")
def z01_time_to_live(t):
    """No event time: ids are forgotten a while after they arrived."""
    base = scratch_folder(t.spark, "forgetting")
    stream = stream_of(t, "documents").select(F.md5("text").alias("review_id"), F.length("text").alias("chars"))
    ingest.run_to_end(ingest.append_to(ingest.unique_since(stream, "review_id", "1 hour"), f"{base}/out", f"{base}/progress"))
    return t.spark.read.parquet(f"{base}/out")


@query("z02_stored_counters", """
    WITH r AS (SELECT CASE WHEN n_chars % 5 > 0 THEN md5(text) END AS id, lang IS NOT NULL AND lang <> 'de' AS valid FROM documents),
    v AS (SELECT id FROM r WHERE valid AND id IS NOT NULL)
    SELECT count(DISTINCT id) AS accepted, (SELECT count(*) FROM r) - count(*) AS rejected, count(*) - count(DISTINCT id) AS duplicate FROM v""")
def z02_counters(t):
    """Reviews without an id or in another language are rejected; two runs, the second goes on from the stored counts."""
    base = scratch_folder(t.spark, "counters")
    docs = t.documents.select(F.when(F.col("n_chars") % 5 > 0, F.md5("text")).alias("review_id"), "lang", "source")
    for part in ("source < 'm'", "source >= 'm' OR source IS NULL"):
        docs.where(part).write.mode("append").parquet(f"{base}/in")
        stream = ingest.read_folder(t.spark, f"{base}/in", docs.schema)
        ingest.run_to_end(ingest.count_arrivals(stream, "review_id", F.col("lang") != "de", f"{base}/out", f"{base}/progress"))
    return ingest.arrivals(t.spark, f"{base}/out")


@query("z02_resume_from_checkpoint", "SELECT lang, count(*) AS reviews, count(DISTINCT doc_id) AS ids FROM documents GROUP BY 1")
def z02(t):
    """Two runs over a growing folder: the second reads only what is new."""
    base = scratch_folder(t.spark, "resume")
    docs = t.documents.select("doc_id", "lang")
    for part in ("lang = 'en'", "lang <> 'en'"):
        docs.where(part).write.mode("append").parquet(f"{base}/in")
        stream = ingest.read_folder(t.spark, f"{base}/in", docs.schema, files_per_batch=1)
        ingest.run_to_end(ingest.append_to(stream, f"{base}/out", f"{base}/progress"))
    out = t.spark.read.parquet(f"{base}/out")
    # Copies of an id would show as more reviews than ids.
    return out.groupBy("doc_id", "lang").count().groupBy("lang").agg(
        F.sum("count").alias("reviews"), F.count(F.lit(1)).alias("ids"))


@query("z03_running_sums", """
    SELECT user_id, count(value) AS n, R6(avg(value)) AS mean, R6(stddev_samp(value)) AS std, R6(min(value)) AS lowest, R6(max(value)) AS highest FROM events GROUP BY 1""")
def z03(t):
    base = scratch_folder(t.spark, "sums")
    events = t.events.select("user_id", "value", "event_type")
    for part in ("event_type = 'click'", "event_type <> 'click'"):
        events.where(part).write.mode("append").parquet(f"{base}/in")
        stream = ingest.read_folder(t.spark, f"{base}/in", events.schema)
        ingest.run_to_end(ingest.write_updates(ingest.running_sums(stream, ["user_id"], "value"), ["user_id"], f"{base}/out", f"{base}/progress"))
    sums = ingest.finish_sums(ingest.latest_rows(t.spark, f"{base}/out", ["user_id"]))
    return sums.select("user_id", "n", *[r6(c).alias(c) for c in ("mean", "std", "lowest", "highest")])


@query("z04_streamed_smallest", """
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat('42|', event_id)), event_id) AS rn FROM events) WHERE rn <= 5""")
def z04(t):
    base = scratch_folder(t.spark, "smallest")
    events = t.events.select("user_id", "event_id", "event_type")
    order = [sample_score(42, F.col("event_id")), F.col("event_id")]
    for part in ("event_type = 'view'", "event_type <> 'view'"):
        events.where(part).write.mode("append").parquet(f"{base}/in")
        stream = ingest.read_folder(t.spark, f"{base}/in", events.schema)
        ingest.run_to_end(ingest.keep_smallest(stream, "user_id", order, 5, f"{base}/out", f"{base}/progress"))
    return ingest.smallest_rows(t.spark, f"{base}/out", "user_id", order, 5).select("user_id", "event_id")


def in_two_batches(t, name, start):
    """Clicks and purchases arrive first; the rest comes later, so what is old among it is late."""
    base = scratch_folder(t.spark, name)
    events = t.events.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    for part in ("event_type IN ('click', 'purchase')", "event_type NOT IN ('click', 'purchase')"):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = ingest.read_folder(t.spark, f"{base}/in", events.schema)
        ingest.run_to_end(start(stream, f"{base}/out", f"{base}/progress"))
    return f"{base}/out"


# Both batches and what is late in the second: windows that end a day or more before the latest time of the first.
BATCHES = """
    b AS (SELECT event_id, user_id, value, ts, event_type IN ('click', 'purchase') AS early FROM events),
    mark AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM b WHERE early)"""


def window_sql(width, slide):
    """Counts per user and window; a window starts at every multiple of ``slide`` hours."""
    return f"""
    WITH {BATCHES},
    w AS (SELECT b.*, time_bucket(INTERVAL {slide} HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL {slide} HOUR AS start FROM b, range({width // slide}) r(i))
    SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n, R6(sum(value)) AS total FROM w, mark
    WHERE early OR start + INTERVAL {width} HOUR > mark GROUP BY 1, 2"""


def windows_of(rows):
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n", r6("total").alias("total"))


@query("z05_tumbling_counts", window_sql(6, 6))
def z05_tumbling(t):
    """Reviews per user and six hours, late rows left out."""
    start = lambda s, out, progress: ingest.write_updates(ingest.windowed(s, "ts", ["user_id"], "value", "6 hours"), ["window", "user_id"], out, progress)
    return windows_of(ingest.latest_rows(t.spark, in_two_batches(t, "tumbling", start), ["window", "user_id"]))


@query("z05_sliding_counts", window_sql(12, 6))
def z05_sliding(t):
    """Reviews per user and twelve hours, starting every six."""
    start = lambda s, out, progress: ingest.write_updates(ingest.windowed(s, "ts", ["user_id"], "value", "12 hours", "6 hours"), ["window", "user_id"], out, progress)
    return windows_of(ingest.latest_rows(t.spark, in_two_batches(t, "sliding", start), ["window", "user_id"]))


@query("z05_session_counts", f"""
    WITH {BATCHES},
    e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 3 HOUR, true) AS opens FROM b),
    s AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM e)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, user_id, count(*) AS n, R6(sum(value)) AS total
    FROM s GROUP BY user_id, number HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM b)""")
def z05_sessions(t):
    """Closed sessions of a user: rows less than three hours apart, closed a day after.

    All files arrive in one batch, so no row is late; they are many, as one file of few row groups is one task's work.
    """
    base = scratch_folder(t.spark, "sessions")
    events = t.events.select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    storage.spread(events, "event_id", "ts").write.parquet(f"{base}/in")
    files = len(t.spark.read.schema(events.schema).parquet(f"{base}/in").inputFiles())
    stream = ingest.read_folder(t.spark, f"{base}/in", events.schema, files_per_batch=files)
    ingest.run_to_end(ingest.append_to(ingest.sessions(stream, "ts", ["user_id"], "value", "3 hours"), f"{base}/out", f"{base}/progress"))
    found = t.spark.read.parquet(f"{base}/out")
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select(form("window.start").alias("start"), form("window.end").alias("stop"), "user_id", "n", r6("total").alias("total"))


@query("z05_late_rows", f"""
    WITH {BATCHES}
    SELECT event_id FROM b, mark WHERE NOT early AND time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= mark""")
def z05_late(t):
    """The rows that the tumbling windows leave out."""
    start = lambda s, out, progress: ingest.keep_late(s, "ts", "6 hours", "1 day", out, progress)
    return t.spark.read.parquet(in_two_batches(t, "late", start) + "/late").select("event_id")
