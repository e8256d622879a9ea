"""Music and restaurant preparation on hand-made rows."""

import pytest

from mapwright.operators import domains as D

MUSIC = "ord int, review_id string, artist_mbid string, text string, matched string, rating string, created string, language string, original_entity_type string"


def music(spark, rows):
    return spark.createDataFrame([(k, *row, "EN ", " Release") for k, row in enumerate(rows)], MUSIC)


def test_music_reviews(spark):
    raw = music(spark, [
        ("r1", "a", " first  copy ", "yes", "5", "2020"), (" r1 ", "a", "second copy", "True", "4", "2021"),
        ("r2", "a", "no match", "no", "4", "2020"), ("r3", " ", "no artist", "1", "4", "2020"), (" ", "a", "no id", "1", "4", "2020"),
        ("r4", "b", " ", "1", "4", "2020"), ("r5", "b", "odd rating", "1", "9", " nan "), ("r6", "b", "unknown", None, "1", None)])
    rows = {r.review_id: r for r in D.music_reviews(raw, ["ord"]).collect()}
    assert set(rows) == {"r1", "r5"}
    assert (rows["r1"].review_text, rows["r1"].rating, rows["r1"].language, rows["r1"].original_entity_type) == ("first copy", 5.0, "en", "release")
    assert rows["r5"].rating is None and rows["r5"].review_date is None and rows["r5"].review_word_count == 2
    assert D.music_reviews(raw.where("false"), ["ord"]).count() == 0


def test_review_id_of_several_artists_is_an_error(spark):
    raw = music(spark, [("r1", "a", "x", "1", "5", None), ("r1", "b", "x", "1", "5", None)])
    with pytest.raises(Exception, match="several artists: r1"):
        D.music_reviews(raw, ["ord"]).collect()


def test_restaurant_reviews(spark):
    schema = "ord int, review_id string, business_id string, text string, rating double, date string, useful string, funny int, cool int"
    raw = spark.createDataFrame([
        (1, "r1", " a ", "good food", 5.0, " ", "3.0", None, 1), (2, "r1", "a", "again", 4.0, "d", "1", 1, 1),
        (3, "r2", "z", "not on the map", 4.0, "d", "1", 1, 1), (4, None, "a", "no id", 4.0, "d", "1", 1, 1),
        (5, "r3", "a", "\t", 4.0, "d", "1", 1, 1), (6, "r4", "b", "fine", 0.5, "2019", "x", 2, 0)], schema)
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "business_id string")
    rows = {r.review_id: r for r in D.restaurant_reviews(raw, ids, ["ord"]).collect()}
    assert set(rows) == {"r1", "r4"}
    assert (rows["r1"].business_id, rows["r1"].useful, rows["r1"].funny, rows["r1"].review_date) == ("a", 3, 0, None)
    assert rows["r4"].rating is None and rows["r4"].useful == 0


def test_blank_and_repeated_artists_are_errors(spark):
    schema = "mbid string, listeners long, ambiguous boolean, tags_lastfm string"
    for rows, problem in (([(" ", 5000, False, "x")], "blank"), ([("a", 5000, False, "x"), ("a", 6000, False, "y")], "repeats")):
        with pytest.raises(Exception, match=problem):
            D.artist_texts(spark.createDataFrame(rows, schema)).collect()
