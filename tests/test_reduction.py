"""Numeric reductions against NumPy, and what every finished map must satisfy."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from mapwright.functions.constants import ENGLISH_STOPWORDS
from mapwright.operators import encode, metrics, reduce, tfidf
from mapwright.plans import catalog


def test_svd_matches_numpy(spark, tables):
    docs = tables.documents.where("lang = 'en'").select("doc_id", "text").where("length(text) < 2000")
    counts = tfidf.term_counts(docs, "doc_id", "text", ENGLISH_STOPWORDS).cache()
    fitted = reduce.fit_svd(counts, docs, "doc_id", components=5, limit=200)
    vocab = fitted.vocabulary(spark)
    rows = {r.doc_id: r for r in tfidf.sparse_rows(tfidf.transform(counts, vocab, "doc_id"), vocab, "doc_id").collect()}
    dense = np.zeros((len(rows), len(fitted.terms)))
    for i, key in enumerate(sorted(rows)):
        dense[i, rows[key].positions] = rows[key].weights
    want = np.linalg.svd(dense, compute_uv=False)[:5]
    assert np.allclose(fitted.singular, want, rtol=0.02)
    assert np.allclose(np.linalg.norm(dense, axis=1), 1.0)
    assert np.allclose(fitted.basis.T @ fitted.basis, np.eye(5), atol=1e-8)
    out = {r.doc_id: np.array(r.embedding) for r in reduce.project_svd(counts, fitted, docs, "doc_id").collect()}
    for i, key in enumerate(sorted(rows)):
        plain = dense[i] @ fitted.basis
        assert np.allclose(out[key], plain / np.linalg.norm(plain), atol=1e-8)
    for key in set(out) - set(rows):
        assert not out[key].any()


def test_layout_keeps_the_widest_directions(spark, tables):
    rows = tables.embeddings.collect()
    m = np.array([r.embedding for r in rows], dtype=float)
    placed = {r.vec_id: (r.x, r.y) for r in reduce.layout_2d(tables.embeddings, "vec_id").collect()}
    axes = np.linalg.eigh(np.cov(m.T))[1][:, ::-1][:, :2]
    axes = axes * np.where(axes[np.argmax(np.abs(axes), axis=0), [0, 1]] < 0, -1.0, 1.0)
    assert np.allclose(np.array([placed[r.vec_id] for r in rows]), m @ axes, atol=1e-6)


def test_any_encoder_can_be_used(spark):
    df = spark.createDataFrame([("e", "r1", "aa b"), ("e", "r2", "a"), ("f", "r3", "  ")], "entity_id string, review_id string, review_text string")
    got = encode.review_embeddings(df, encoder=lambda texts: np.array([[float(len(t)), 1.0] for t in texts])).collect()
    assert [(r.entity_id, r.review_count) for r in got] == [("e", 2)]
    assert np.allclose(got[0].embedding, np.array([2.5, 1.0]) / np.hypot(2.5, 1.0))


def test_quality_of_a_perfect_layout(spark):
    pts = [(f"p{i:03d}", [float(i % 7), float(i // 7) * 1.3]) for i in range(60)]
    df = spark.createDataFrame(pts, "id string, source array<double>").withColumn("map", F.col("source"))
    row = metrics.quality_scores(metrics.projection_quality(df, limit=60, k=5)).first()
    assert row.trustworthiness == 1.0 and row.knn_preservation == 1.0


def test_samples_above_their_limit_are_refused(spark):
    df = spark.range(40).select(F.format_string("%02d", "id").alias("id"), F.array(F.rand(1)).alias("source"), F.array(F.rand(2)).alias("map"))
    with pytest.raises(Exception, match="exceeds its limit"):
        metrics.projection_quality(df, limit=20).collect()


def test_mixing_needs_two_classes(spark, tables):
    row = metrics.label_mixing(tables.map_items, F.lit("one")).first()
    assert row.knn_accuracy is None and row.query_items == 0


@pytest.mark.parametrize("name", ["c01_movie_map", "c05_three_domain_map", "c06_feel_map"])
def test_finished_maps(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    assert rows and len({r.id for r in rows}) == len(rows)
    assert all(4.0 <= r.visual_size <= 80.0 and r.cluster >= -1 and r.cluster_label for r in rows)
    labels = {}
    for r in rows:
        labels.setdefault(r.cluster, set()).add(r.cluster_label)
    assert all(len(found) == 1 for found in labels.values())
