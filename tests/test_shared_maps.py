"""Maps of several domains on hand-made tables: whole reviews, and the same rows by cheaper steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.functions import values as V
from mapwright.operators import fusion, reduce
from mapwright.plans import catalog, jobs

COLUMNS = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}
KINDS = ("STANDARD", "SMALL", "LARGE", "ECONOMY", "MEDIUM")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three movies and three artists, with 180 reviews for each three."""
    path = tmp_path_factory.mktemp("shared")
    rows = {
        "part": [(i, f"film {i}", "b", KINDS[i % 5], 10, 1.0) for i in range(1, 4)],
        "customer": [(i, f"artist {i}", 4 + i, 2000.0 + i, ("FURNITURE", "MACHINERY", "BUILDING")[i - 1]) for i in range(1, 4)],
        "supplier": [(1, "place 1", 2, 1.0)],
        "nation": [(i, f"land {i}", 0) for i in range(10)],
        "lineitem": [(k, 1 + k % 3, 1, k, float(1 + k % 5), 1.0, "ARN"[k % 2], "O") for k in range(30)],
        "documents": [(i, f"review {'good bad dull'.split()[i % 3]} word{i}", "en", "s", 10 + i) for i in range(180)],
        "labels": [(i, 1, 0) for i in range(0, 180, 2)],
    }
    for name, found in rows.items():
        spark.createDataFrame(found, COLUMNS[name]).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_two_domain_map_takes_every_review(spark, folder, monkeypatch):
    kept, store = {}, jobs.stored

    def spy(df, name):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(jobs, "stored", spy)
    assert catalog.queries()["c04_movies_music_map"](spark, folder).count() == 6
    assert {(r.id, r.review_count) for r in kept["reviews"].collect()} == {
        (i, 60) for i in ("movies:1", "movies:2", "movies:3", "music:artist 1", "music:artist 2", "music:artist 3")}
    assert kept["entities"].agg(F.sum("review_count")).first()[0] == 360


ODD = ["Dark; witty|Film, sci-fi", " - a--b\tc\x0bd e f ", "", None, "İstanbul ÉCLAIR naïve", "x,y;z|w", "𝒳 1st\r\n2nd", "'q' \"r\" (s)", "  "]


def test_words_are_found_in_one_pass(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    rows = df.select(T.words(T.semantic_text(F.col("t"))).alias("a"), F.filter(F.split(T.label_text(F.col("t")), " "), lambda w: w != "").alias("b"), T.label_words(F.col("t")).alias("c")).collect()
    assert all(r.a == r.b == r.c for r in rows) and rows[0].c == ["dark", "witty", "film", "sci-fi"]


def test_each_text_of_an_entity_is_cleaned_once(spark):
    pieces = spark.createDataFrame([(f"movies:{i % 5}", ("dark film noir", "witty film")[i % 2]) for i in range(400)] + [("movies:0", None)], "id string, text string")
    words = jobs.shared_words(pieces, ["movies"])
    lines = words._jdf.queryExecution().executedPlan().toString().splitlines()
    cleaned = min(i for i, x in enumerate(lines) if "Generate" in x)
    assert any("HashAggregate" in x for x in lines[cleaned:]) and "regexp_replace" not in "".join(lines)
    assert {(r.id, r.text) for r in words.collect()} == {(f"movies:{i}", w) for i in range(5) for w in ("dark", "noir", "witty")}
    assert words.count() == 15


def test_whole_numbers_need_no_pattern(spark):
    plan = spark.range(3).select(V.global_id(F.lit("movies"), F.col("id")).alias("id"))
    assert "regexp_replace" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in plan.collect()] == ["movies:0", "movies:1", "movies:2"]


def test_ratings_are_read_once(spark, tmp_path):
    spark.createDataFrame([(k % 4, float(k % 5)) for k in range(40)], "movie_id long, rating double").write.parquet(f"{tmp_path}/ratings-once")
    movies = spark.createDataFrame([(i, f"film {i}", "Drama") for i in range(4)], "movie_id long, title string, genres string")
    out = jobs.movie_entities(movies, spark.read.parquet(f"{tmp_path}/ratings-once"))
    assert "ratings-once" not in out._jdf.queryExecution().toString()
    assert {(r.id, r.rating_count) for r in out.collect()} == {(f"movies:{i}", 10) for i in range(4)}


def test_vectors_side_by_side(spark):
    rows = [("a", [3.0, 4.0], [1.0, 0.0, 2.0]), ("b", [0.0, 1.0], None), ("c", [0.0, 0.0], None), (None, [1.0, 1.0], [0.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "id string, a array<double>, b array<double>")
    got = {r.id: np.array(r.embedding) for r in fusion.concat_fusion_rows(df, "id", "a", "b", 3, 0.35).collect()}
    whole = df.withColumn("b", F.coalesce("b", F.array_repeat(F.lit(0.0), 3)))
    want = {r.id: np.array(r.e) for r in whole.select("id", fusion.concat_fusion(F.col("a"), F.col("b"), 0.35).alias("e")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-14) for k in want)
    with pytest.raises(Exception, match="3 elements"):
        fusion.concat_fusion_rows(df.withColumn("b", F.array(F.lit(1.0))), "id", "a", "b", 3, 0.35).collect()


def test_layout_reads_vectors_twice_and_loses_no_digits(spark):
    """One pass for the directions, one for the places; a large part that all vectors share changes nothing."""
    rng = np.random.default_rng(8)
    m = rng.normal(0, [1, 3, 2, 1], (300, 4)) + 1e6
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, embedding array<double>").repartition(5)
    axes = np.linalg.eigh(np.cov(m.T))[1][:, ::-1][:, :2]
    axes = axes * np.where(axes[np.argmax(np.abs(axes), axis=0), [0, 1]] < 0, -1.0, 1.0)
    placed = reduce.layout_2d(df, "id")
    assert np.allclose([(r.x, r.y) for r in placed.orderBy("id").collect()], m @ axes, rtol=1e-9)
    assert "UDF" not in placed._jdf.queryExecution().executedPlan().toString()
    for rows, problem in (([], "no vector"), ([[1.0, 2.0]], "one vector alone"), ([[1.0, 2.0], [1.0]], "2 elements"), ([[1.0, 2.0], None], "missing")):
        bad = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id long, embedding array<double>").coalesce(1)
        with pytest.raises(Exception, match=problem):
            reduce.layout_2d(bad, "id")


def test_bundles_label_regions_once(spark, folder):
    """The finished map, which a bundle goes over four times, holds no work on the words."""
    from mapwright.plans.fixtures import Tables
    from mapwright.plans.q_datasets import two_domain_map

    out = two_domain_map(Tables(spark, folder))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6 and out.where("cluster_label IS NULL").count() == 0
