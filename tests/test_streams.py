"""Generations of stored batches, counters over a restart, and ids that are forgotten."""

import time

import pytest
from pyspark.sql import functions as F

from mapwright.plans.catalog import queries
from mapwright.streaming import generations as G
from mapwright.streaming import ingest


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_live_parts_hold_every_batch_once(fan):
    for batches in range(1, 300):
        held = [part * fan**g + k for g, part in G.live_parts(batches, fan) for k in range(fan**g)]
        assert held == list(range(batches))
        generations = [g for g, _ in G.live_parts(batches, fan)]
        assert all(generations.count(g) < fan for g in generations)
        written = {(0, b) for b in range(batches)} | {m for b in range(batches) for m in G.merges(b, fan)}
        assert set(G.live_parts(batches, fan)) <= written


def test_rows_read_stay_bounded(spark, tmp_path):
    """Every batch changes all three keys; 30 batches, one of them repeated, leave a few parts of three rows."""
    path, keys = f"{tmp_path}/sums", ["k"]
    merge = lambda rows: ingest.newest(rows, keys)
    for number in [*range(20), 19, *range(20, 30)]:
        batch = spark.range(3, numPartitions=1).select(F.col("id").alias("k"), F.lit(number * 10).alias("v"), F.lit(number).alias("_batch"))
        G.add_batch(batch, number, path, merge, fan=4)
    rows = G.stored_rows(spark, path, fan=4)
    assert rows.count() == 3 * len(G.live_parts(30, 4)) == 18  # 30 is 132 to the base of 4
    assert {tuple(r) for r in merge(rows).select("k", "v").collect()} == {(k, 290) for k in range(3)}
    left = {int(p.name) for p in (tmp_path / "sums" / "generation-0").iterdir()}
    assert left == set(range(24, 30))  # batches 20 to 23 went with batch 27; 24 to 27 wait for readers of batch 27


def test_counters_over_a_restart(spark, tmp_path):
    rows = [("a", 1), ("a", 1), ("b", 1), (None, 1), ("c", 0), ("b", None)]
    more = [("a", 1), ("d", 1), ("c", 1), ("d", 0)]
    schema = "id string, good int"

    def run(batches, name):
        base = f"{tmp_path}/{name}"
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = ingest.read_folder(spark, f"{base}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
            ingest.run_to_end(ingest.count_arrivals(stream, "id", F.col("good") == 1, f"{base}/out", f"{base}/progress"))
        kept = [r.id for r in spark.read.parquet(f"{base}/out/rows").collect()]
        return tuple(ingest.arrivals(spark, f"{base}/out").first()), sorted(kept)

    stopped = run([rows, more], "stopped")
    assert stopped == run([rows + more], "whole") == ((4, 4, 2), ["a", "b", "c", "d"])


def test_ids_are_forgotten_after_the_limit(spark, tmp_path):
    schema = "id string, n int"

    def run(ids, n):
        spark.createDataFrame([(i, n) for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.read_folder(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        query = ingest.append_to(ingest.unique_since(stream, "id", "2 seconds"), f"{tmp_path}/out", f"{tmp_path}/progress")
        ingest.run_to_end(query)
        return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])

    run(["a", "a", "b"], 1)
    time.sleep(5)
    run(["c"], 2)  # the watermark passes the first ids
    held = run(["a", "c"], 3)
    kept = sorted((r.id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert kept.count(("a", 1)) == 1 and ("a", 3) in kept and ("b", 1) in kept and ("c", 2) in kept
    assert held <= 2  # "b" is gone from the state


@pytest.mark.parametrize("name", ["z01_streamed_dedupe", "z01_dedupe_with_time_to_live"])
@pytest.mark.parametrize("parts", [1, 11])
def test_streamed_table_is_a_file_or_a_folder(spark, tmp_path, name, parts):
    """Larger tables lie in folders of part files; the pattern of one file's name found none of them."""
    rows = spark.range(40).selectExpr("id AS doc_id", "IF(id % 5 = 0, NULL, concat('text ', id % 17)) AS text")
    target = f"{tmp_path}/documents.parquet"
    if parts == 1:
        rows.toPandas().to_parquet(target)
    else:
        rows.repartition(parts).write.parquet(target)
    spark.createDataFrame([(1, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents_old.parquet")
    found = queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r["chars"] or 0 for r in found) == sorted([0] + [len(f"text {k}") for k in range(17)])
