"""What the jobs must refuse, and inputs that must not be lost."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mapwright.functions import lists, text, values
from mapwright.operators import fusion, naming, ranking
from mapwright.operators import prepare as P
from mapwright.sources import readers, vectors, writers


def test_global_ids_repeat(spark):
    part = spark.createDataFrame([(1.0, "a"), (1.0, "b")], "source_id double, title string")
    with pytest.raises(Exception, match="id repeats: movies:1"):
        P.union_domains({"movies": part}).collect()


def test_vectors_of_unequal_size(spark):
    base = spark.createDataFrame([("m", "1", [1.0, 0.0, 2.0])], "domain string, entity_id string, embedding array<double>")
    rev = spark.createDataFrame([("m", "1", [1.0, 0.0], 4)], "domain string, entity_id string, embedding array<double>, review_count int")
    with pytest.raises(Exception, match="unequal sizes"):
        fusion.fuse_modalities(base, rev, 3).collect()


@pytest.mark.parametrize("names", [[(0, "a")], [(0, "a"), (1, "b"), (2, "c")], [(0, "a"), (1, " ")], [(0, "a"), (1, "A")]])
def test_names_that_do_not_fit(spark, names):
    items = spark.createDataFrame([("x", 0, "old"), ("y", 1, "old"), ("z", -1, "noise")], "id string, cluster int, cluster_label string")
    with pytest.raises(ValueError, match="names do not fit"):
        naming.apply_names(items, spark.createDataFrame(names, "cluster int, name string"))


def test_vector_tables(spark, tmp_path):
    bad = spark.createDataFrame([("1", [1.0, 2.0], 1), ("1", [1.0], 1)], "entity_id string, embedding array<float>, review_count int")
    with pytest.raises(ValueError, match="contract"):
        vectors.write_vectors(bad, str(tmp_path / "bad"), "m")
    good = spark.createDataFrame([("1", [1.0, 2.0], 1), ("2", [1.0, 0.0], 1)], "entity_id string, embedding array<float>, review_count int")
    vectors.write_vectors(good, str(tmp_path / "good"), "m")
    assert vectors.read_vectors(spark, str(tmp_path / "good/vectors")).count() == 2


def test_every_shard_is_a_file_of_json(spark, tmp_path):
    """Each of 256 files a domain is one JSON object, the empty ones too; no row is lost to odd ids, texts or domains."""
    rows = [("movies", f"{i}", f'a "quoted"\n{{line}}, {i}', float(i)) for i in range(1500)]
    rows += [("music", "1", None, float("nan")), ("music", "1", "again", 1.0), (None, ",{", "x", 2.0), ("", None, "y", 3.0)]
    details = spark.createDataFrame(rows, "domain string, source_id string, title string, value double")
    writers.write_shards(details, str(tmp_path / "s"))
    files = writers.shard_files(spark, str(tmp_path / "s")).collect()
    assert len(files) == 3 * 256 and {r["files"] for r in files} == {1} and sum(r["count"] for r in files) == len(rows)
    found = list((tmp_path / "s/items").glob("domain=*/shard=*/part-*"))
    assert len(found) == 3 * 256
    held = [pair for f in found for pair in json.loads(f.read_text(), object_pairs_hook=list)]
    assert len(held) == len(rows)
    movies = {}
    for f in (tmp_path / "s/items/domain=movies").glob("shard=*/part-*"):
        ids = [k for k, _ in json.loads(f.read_text(), object_pairs_hook=list)]
        assert ids == sorted(ids)
        movies |= json.loads(f.read_text())
    assert movies["7"] == {"source_id": "7", "title": 'a "quoted"\n{line}, 7', "value": 7.0} and len(movies) == 1500
    items, index = writers.read_shards(spark, str(tmp_path / "s"), "source_id string, title string, value double")
    back = {(r["domain"], r["source_id"], r["title"], r["value"]) for r in items.collect()}
    assert back == {(d or None, i or "", t, None if v != v else v) for d, i, t, v in rows}
    assert index.count() == 3 * 256 and index.agg(F.sum("count")).first()[0] == len(rows)


def test_csv_is_bound_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text('title,rating,movieId,genres\n"A, ""B""",NaN,1,x|y\nC,abc,2,\nD,3.5,,z\n')
    rows = readers.read_csv(spark, str(tmp_path / "m.csv"), "movieId int, title string, rating double").collect()
    assert [tuple(r) for r in rows] == [(1, 'A, "B"', None), (2, "C", None), (None, "D", 3.5)]
    with pytest.raises(ValueError, match="lacks"):
        readers.read_csv(spark, str(tmp_path / "m.csv"), "movieId int, absent string")


@pytest.mark.parametrize("split", ["128m", "64"])
def test_json_of_every_form(spark, tmp_path, split):
    """Arrays, objects in a row, lines and pretty printing; braces in texts; files of several splits."""
    (tmp_path / "a.json").write_text('[{"review_id": "1", "movie": "} {", "helpful": ["1", "2"]},\n {"review_id": "2", "movie": "x\\"}"}]')
    (tmp_path / "b.json").write_text('{"review_id": "3"} {"review_id": "4"}{"review_id":\n "5", "extra": {"deep": {}}}\n')
    (tmp_path / "c.json").write_text("".join(f'{{"review_id": "{k}", "movie": "m{k}"}}\n' for k in range(6, 60)))
    (tmp_path / "d.json").write_text("[]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = {r.review_id: r for r in readers.read_json_array(spark, str(tmp_path), readers.RAW_MOVIE_REVIEW).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert set(rows) == {str(k) for k in range(1, 60)}
    assert rows["1"].movie == "} {" and rows["1"].helpful == ["1", "2"] and rows["2"].movie == 'x"}'


@pytest.mark.parametrize("split", ["61", "700", "128m"])
def test_json_records_over_borders(spark, tmp_path, split):
    """Nested objects, braces, quotes and escapes in texts: the same objects wherever the file is split."""
    rng = random.Random(7)

    def value(depth):
        kind = rng.randrange(5 if depth else 2)
        if kind < 2:
            return "".join(rng.choice('ab{}[],:"\\\né ') for _ in range(rng.choice([0, 3, 12, 150])))
        if kind < 4:
            return {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}
        return [value(depth - 1) for _ in range(rng.randrange(3))]

    records = [{"id": i, "v": value(3), "w": {} if i % 3 else [{}]} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(records[:20], indent=1, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text("".join(json.dumps(r) for r in records[20:40]))
    (tmp_path / "c.json").write_text("[" + ",\n".join(json.dumps(r, ensure_ascii=False) for r in records[40:]) + "]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = [json.loads(r["record"]) for r in readers.json_records(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(found, key=lambda r: r["id"]) == records


@pytest.mark.parametrize("bad", ['[{"a": 1}, {"a": {"b": 2}', '{"a": "x} {"a": 1}', 'x {"a": 1}', '{"a": 1}} {"a": 2}'])
def test_what_is_no_list_of_objects_is_an_error(spark, tmp_path, bad):
    (tmp_path / "a.json").write_text(bad)
    with pytest.raises(Exception, match="ends inside an object|something else than objects"):
        readers.json_records(spark, str(tmp_path)).collect()


def test_broken_json_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"review_id": "1"}, {"review_id": "2')
    with pytest.raises(Exception, match="ends inside an object"):
        readers.read_json_array(spark, str(tmp_path), readers.RAW_MOVIE_REVIEW).collect()


def test_keys_and_lists(spark):
    row = spark.createDataFrame([(12345678.0, "3000000000", "Dvořák Ştefan (1999)", "['a, b', 'c']")], "d double, n string, t string, l string").select(
        values.id_key(F.col("d")).alias("id"), values.to_int(F.col("n")).alias("n"), text.search_key(F.col("t")).alias("key"), lists.parse_list(F.col("l"), "movies").alias("l")).first()
    assert tuple(row) == ("12345678", 3000000000, "dvorak stefan", ["a, b", "c"])


def test_places_are_gapless(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("score"), "id")
    rows = ranking.places(df, "score", "id").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 1001)) and [r.score for r in rows] == sorted(r.score for r in rows)
