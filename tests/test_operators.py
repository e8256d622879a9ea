"""Operators against brute force, on skewed and awkward inputs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mapwright.operators import density, export, feel, fusion, naming, ranking, sampling
from mapwright.operators import histogram as H
from mapwright.operators import neighbors as NB
from mapwright.operators import prepare as P
from mapwright.operators.datasets import join_one_to_one
from mapwright.sources import readers, storage


def brute_knn(points, k):
    out = {}
    for i, x, y in points:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in points if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


def crowd(n, seed=3):
    """A third of the points in one place, a third in a tiny area, the rest far apart."""
    r = random.Random(seed)
    pts = [(f"s{i:04d}", 1.0, 1.0) for i in range(n // 3)]
    pts += [(f"c{i:04d}", 1.0 + r.random() * 1e-6, 1.0 + r.random() * 1e-6) for i in range(n // 3)]
    return pts + [(f"f{i:04d}", r.uniform(-1e3, 1e3), r.uniform(-1e3, 1e3)) for i in range(n - len(pts))]


@pytest.mark.parametrize("k,tile", [(3, 16), (5, 60)])
def test_nearest_items_on_a_crowd(spark, k, tile):
    pts = crowd(600)
    got = NB.nearest_items(spark.createDataFrame(pts, "id string, x double, y double"), k, tile).orderBy("qid", "rank").collect()
    found = {}
    for row in got:
        found.setdefault(row.qid, []).append(row.rid)
    assert found == brute_knn(pts, k)


def test_nearest_items_with_fewer_points_than_k(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0)], "id string, x double, y double")
    assert {(r.qid, r.rid) for r in NB.nearest_items(df, 5).collect()} == {("a", "b"), ("b", "a")}


def test_rank_by_histogram_matches_pandas(spark):
    r = random.Random(1)
    rows = [(g, v) for g in "ab" for v in
            [r.choice([-3.0, 0.0, -0.0, 5.0, 1e-9, 2.5e8]) for _ in range(60)] + [1000 + r.random() * 1e-3 for _ in range(300)] + [None]]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["want"] = pdf.groupby("g")["v"].rank(pct=True)
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, g string, v double")
    hist = H.value_histogram(df, ["g"], "v", piece_values=20)
    got = df.join(hist, ["g", "v"], "left").select("i", ((F.col("below") + (F.col("cnt") + 1) / 2) / F.col("total")).alias("p"))
    for row in got.collect():
        want = pdf.loc[row.i, "want"]
        assert (row.p is None and np.isnan(want)) or abs(row.p - want) < 1e-12


def test_percentiles_match_numpy(spark):
    values = [float(v) for v in random.Random(5).sample(range(-500, 500), 101)] + [7.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = H.exact_percentiles(df, [], "v", [0.0, 0.2, 0.5, 0.75, 1.0]).first()
    assert np.allclose(list(got), np.quantile(values, [0.0, 0.2, 0.5, 0.75, 1.0]))


def test_size_of_constant_and_missing_input(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", None)], "id string, popularity double")
    sizes = {r.id: r.visual_size for r in ranking.percentile_size(df).collect()}
    assert sizes["c"] == 4.0 and sizes["a"] == sizes["b"] > 4.0
    assert {r.visual_size for r in ranking.min_max_size(df.where("popularity > 0"), "popularity").collect()} == {5.0}


def test_first_copy_wins_even_when_blank(spark):
    rows = [(1, "r1", "m1", " "), (2, "r1", "m1", "good"), (3, "r2", "m1", "fine"), (4, " ", "m1", "x"), (5, "r3", None, "x")]
    raw = spark.createDataFrame(rows, "ord int, review_id string, entity_id string, review_text string")
    raw = raw.withColumn("rating", F.lit("11")).withColumn("spoiler_tag", F.lit("1")).withColumn("helpful", F.lit("[1, 2]"))
    kept = P.prepare_reviews(raw, ["ord"]).collect()
    assert [(r.review_id, r.rating, r.spoiler_tag) for r in kept] == [("r2", None, 1)]
    lost = P.rejection_counts(raw).first()
    assert (lost.input_rows, lost.missing_entity, lost.missing_review_id, lost.duplicates) == (5, 1, 1, 1)


def test_join_one_to_one_refuses_copies(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="join key repeats"):
        join_one_to_one(a, spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), ["k"]).collect()


def test_linkage_outcomes(spark):
    from mapwright.operators.linkage import link_reviews

    movies = spark.createDataFrame([(1, "Heat (1995)"), (2, "Solo (1996)"), (3, "Solo (2018)"), (4, "Twin (1990)"), (5, "Twin (1990)")], "movie_id bigint, title string")
    cases = {
        "Heat (1995)": ("accepted", "exact_title_year"), "HEAT (I) (1995)": ("accepted", "exact_title_year"),
        "Heat (1996)": ("unmatched", "title_found_but_year_mismatch"), "Heat": ("accepted", "unique_exact_title_without_year"),
        "Solo": ("ambiguous", "exact_title_multiple_candidates_without_year"), "Twin (1990)": ("ambiguous", "exact_title_year_multiple_candidates"),
        "Nope (2001)": ("unmatched", "no_exact_title_year_match"), "Nope": ("unmatched", "no_exact_title_match"),
        "???": ("invalid", "empty_normalized_title"), " ": ("invalid", "missing_title")}
    reviews = spark.createDataFrame([(t,) for t in cases] + [(None,)], "movie string")
    got = {r.movie: (r.match_status, r.match_method) for r in link_reviews(reviews, movies).collect()}
    assert got.pop(None) == ("invalid", "missing_title")
    assert got == cases


def test_fusion_of_one_missing_modality(spark):
    base = spark.createDataFrame([("m", "1", [3.0, 4.0])], "domain string, entity_id string, embedding array<double>")
    rev = spark.createDataFrame([("m", "2", [0.0, 2.0], 4)], "domain string, entity_id string, embedding array<double>, review_count int")
    got = {r.id: r for r in fusion.fuse_modalities(base, rev, 2).collect()}
    assert got["m:1"].embedding == [0.6, 0.8] and got["m:1"].semantic_source == "base"
    assert got["m:2"].embedding == [0.0, 1.0] and got["m:2"].source_code == 2
    against = spark.createDataFrame([("m", "1", [-3.0, -4.0], 1)], "domain string, entity_id string, embedding array<double>, review_count int")
    with pytest.raises(Exception, match="cancel each other out"):
        fusion.fuse_modalities(base, against, 2).collect()


def test_anchor_table_is_complete(spark):
    anchors = feel.anchor_table(spark)
    assert anchors.count() == 23 and feel.anchor_problems(anchors).count() == 0
    assert feel.anchor_problems(anchors.where("anchor_index <> 1")).count() == 1


def test_zero_deviation_scales_by_one(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    assert feel.scaler(df, ["a"]).first().a_scale == 1.0


def test_density_clusters_follow_long_shapes(spark):
    snake = [(f"s{i}", i * 0.5, 0.0) for i in range(200)]
    blob = [(f"b{i}", 50 + (i % 5) * 0.1, 60 + (i // 5) * 0.1) for i in range(50)]
    far = [("lonely", 0.0, 99.0)]
    df = spark.createDataFrame(snake + blob + far, "id string, x double, y double")
    got = {r.id: r.cluster for r in density.density_clusters(df, 20, 4).collect()}
    assert len(got) == 251 and {got[f"s{i}"] for i in range(200)} == {0}
    assert {got[f"b{i}"] for i in range(50)} == {1} and got["lonely"] == -1


def test_label_ladder_falls_back(spark):
    df = spark.createDataFrame([(1, None, "quiet quiet rain the"), (2, "Drama", "x"), (3, None, "of a")], "cluster int, macro_genre string, tags_text string")
    got = {r.cluster: r.cluster_label for r in naming.region_labels(df).collect()}
    assert got == {1: "quiet / rain", 2: "Drama", 3: "Unknown"}


def test_json_keeps_nulls_and_drops_nan(spark):
    df = spark.range(1).select(F.lit(float("nan")).alias("a"), F.array(F.lit(float("inf")), F.lit(1.0)).alias("b"), F.lit(None).cast("string").alias("c"))
    assert export.as_json(df).first()[0] == '{"a":null,"b":[null,1.0],"c":null}'


def test_item_struct_treats_zero_as_missing(spark):
    df = spark.createDataFrame([("m", 0.0, 3.5, 0)], "movieId string, avg_rating double, stars double, review_count int")
    item = export.item_struct(df, "movies").first()
    assert (item.id, item.title, item.statistics.rating, item.statistics.rating_count, item.domain) == ("m", "Unknown", 3.5, None, "movies")


def test_json_array_files_and_wrappers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"review_id": "1", "movie": "A"},\n {"review_id": "2", "movie": "B"}]')
    assert readers.read_json_array(spark, str(tmp_path / "a.json"), readers.RAW_MOVIE_REVIEW).count() == 2
    (tmp_path / "b.json").write_text('{"nodes": [{"id": "x", "visual": {"cluster": 3}}, {"id": "y", "visual": {"cluster": null}}]}')
    got = {r.id: r.cluster_id for r in readers.read_map_items(spark, str(tmp_path / "b.json")).collect()}
    assert got == {"x": 3, "y": None}


def test_versions_can_be_restored(spark, tmp_path):
    base = str(tmp_path / "v")
    storage.publish(spark.range(3), base, 1)
    storage.publish(storage.read_current(spark, base).where("id > 0"), base, 2)
    assert storage.read_current(spark, base).count() == 2
    storage.point_to(spark, base, 1)
    assert storage.read_current(spark, base).count() == 3


def test_partitioning_does_not_change_results(spark, tables):
    items = tables.map_items
    for job in (
        lambda d: ranking.percentile_size(d).select("id", "visual_size"),
        lambda d: sampling.sample(d, "id", 50).select("id"),
        lambda d: ranking.balanced_domains(d, F.coalesce("review_count", F.lit(0))).select("id"),
        lambda d: NB.nearest_items(d, 3, 32).select("qid", "rid", "rank"),
    ):
        a, b = job(items.repartition(1)), job(items.repartition(13))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
