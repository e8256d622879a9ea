"""What must not grow with the input: Python workers of a task, rows of one task, vectors that are joined."""

import numpy as np
from pyspark.sql import functions as F

from mapwright.operators import feel, neighbors, reduce, tfidf
from mapwright.plans import catalog
from mapwright.streaming import ingest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similarities_take_one_worker_a_task(spark):
    rows = [(i, [float(i == j) for j in range(30)]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    named = feel.anchor_table(spark)
    assert named.count() == feel.N_ANCHORS and "ExistingRDD" not in plan_of(named)
    anchors = F.broadcast(named).join(vectors.select(F.col("vec_id").alias("anchor_index"), F.col("embedding").alias("anchor_vector")), "anchor_index")
    long = feel.anchor_similarities(vectors, anchors).select("vec_id", F.posexplode("similarities").alias("anchor_index", "s"))
    assert plan_of(long).count("ArrowEvalPython") == 1
    assert {(r.vec_id, r.anchor_index) for r in long.where("s = 1").collect()} == {(i, i) for i in range(feel.N_ANCHORS)}


def test_sessions_come_from_many_files_in_one_batch(spark, tmp_path, monkeypatch):
    """Rows in no order of time, no two exactly a gap apart: a second batch would drop them as late, and one file is read by one task."""
    rows = [(i, i % 7, float(i), f"2024-01-{1 + (i * 11) % 20:02d} {i % 24:02d}:{i % 59:02d}:00") for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double, at string").select(
        "event_id", "user_id", "value", F.lit("view").alias("event_type"), F.col("at").cast("timestamp_ntz").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen, read = {}, ingest.read_folder

    def spy(session, path, schema, files_per_batch=8, pattern=None):
        seen.update(files=len(session.read.parquet(path).inputFiles()), most=files_per_batch)
        return read(session, path, schema, files_per_batch, pattern)

    monkeypatch.setattr(ingest, "read_folder", spy)
    found = catalog.queries()["z05_session_counts"](spark, str(tmp_path)).collect()
    assert 1 < seen["files"] <= seen["most"]
    want, last = 0, max(r[3] for r in rows)
    for user in range(7):
        times = sorted(np.datetime64(r[3].replace(" ", "T")) for r in rows if r[1] == user)
        ends = [a for a, b in zip(times, [*times[1:], np.datetime64("2030-01-01")], strict=True) if b - a >= np.timedelta64(3, "h")]
        want += sum(e + np.timedelta64(27, "h") <= np.datetime64(last.replace(" ", "T")) for e in ends)
    assert len(found) == want > 0


def test_svd_joins_weights_not_finished_vectors(spark):
    texts = [(i, " ".join(f"word{(i * k) % 40}" for k in range(1, 9))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    counts = tfidf.term_counts(docs, "doc_id", "text", [])
    fitted = reduce.fit_svd(counts, docs, "doc_id", components=3)
    lines = plan_of(reduce.project_svd(counts, fitted, docs, "doc_id")).splitlines()
    assert min(i for i, x in enumerate(lines) if "MapInArrow" in x) < min(i for i, x in enumerate(lines) if "Join" in x)
    weighted = plan_of(reduce._weighted_rows(counts, fitted, "doc_id"))
    assert weighted.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in weighted
    out = {r.doc_id: np.array(r.embedding) for r in reduce.embed_texts(docs, docs, "doc_id", "text", [], components=3)[0].collect()}
    assert sorted(out) == list(range(62)) and not out[60].any() and not out[61].any() and len(out[61]) == 3
    assert np.allclose([np.linalg.norm(out[i]) for i in range(60)], 1.0)


def test_layout_places_only_the_rows_asked_for(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, [1, 3, 2, 1])]) for i in range(50)], "id long, embedding array<double>")
    whole = {r.id: (r.x, r.y) for r in reduce.layout_2d(vectors, "id").collect()}
    few = {r.id: (r.x, r.y) for r in reduce.layout_2d(vectors, "id", only=vectors.where("id < 9")).collect()}
    assert few == {i: whole[i] for i in range(9)}


def test_neighbour_search_computes_each_python_column_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = rng.uniform(0, 9, (400, 2))
    items = spark.createDataFrame([(f"i{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(at)], "id string, x double, y double")
    plans, write = {}, neighbors.written

    def spy(df, name):
        plans[name] = plan_of(df)
        return write(df, name)

    monkeypatch.setattr(neighbors, "written", spy)
    near = neighbors.nearest_items(items, k=3, tile_rows=20)
    assert {"tiled", "asked", "others"} <= set(plans)
    assert all(plans[n].count("ArrowEvalPython") + plans[n].count("MapInPandas") == 1 for n in ("tiled", "asked", "others"))
    assert "ArrowEvalPython" not in plan_of(near) and "MapInPandas" not in plan_of(near).replace("FlatMapGroupsInPandas", "")
    d = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) + np.diag(np.full(400, np.inf))
    want = {(f"i{i:03d}", f"i{j:03d}") for i in range(400) for j in np.argsort(d[i])[:3]}
    assert {(r.qid, r.rid) for r in near.collect()} == want
