"""Hand-made frames for the cases the tables do not hold."""

import math

import pytest
from pyspark.sql import functions as F

from mapwright.functions import constants as K
from mapwright.functions import lists as L
from mapwright.functions import text as T
from mapwright.functions import values as V
from mapwright.functions import vectors as VX


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("title,year", [("Toy Story (1995)", 1995), ("No year", None), ("2001: A Space Odyssey (1968)", 1968)])
def test_year_in_title(spark, title, year):
    assert one(spark, T.year_in_title(F.col("t")), t=title) == year


def test_first_year_takes_the_first_digits(spark):
    assert one(spark, T.first_year(F.col("t")), t="2001: A Space Odyssey (1968)") == 2001


@pytest.mark.parametrize("title,clean", [
    ("The Half of It (I) (2020)", "The Half of It"), ("After Life (2019– )", "After Life"), ("All About Eve (1950)", "All About Eve")])
def test_strip_review_title(spark, title, clean):
    assert one(spark, T.strip_review_title(F.col("t")), t=title) == clean


def test_match_key(spark):
    assert one(spark, T.match_key(F.col("t")), t="  Tom & Jerry’s — Best (II) ") == "tom and jerry s best"


def test_search_key_drops_accents(spark):
    assert one(spark, T.search_key(F.col("t")), t="Amélie – Été (2001)") == "amelie ete"


def test_collapse_spaces_knows_unicode_blanks(spark):
    assert one(spark, T.collapse_spaces(F.col("t")), t=" a  b\n") == "a b"


@pytest.mark.parametrize("raw,key", [("12.0", "12"), (" 7 ", "7"), ("12.5", "12.5"), ("tt01", "tt01"), (None, "")])
def test_id_key(spark, raw, key):
    assert one(spark, V.id_key(F.col("v").cast("string")), v=raw) == key


def test_helpful_votes(spark):
    both = one(spark, V.helpful_votes(F.col("h")), h='["26", "41"]')
    assert (both.yes, both.total, round(both.ratio, 4)) == (26, 41, 0.6341)
    assert one(spark, V.helpful_votes(F.col("h")), h="[0, 0]").ratio is None
    assert one(spark, V.helpful_votes(F.col("h")), h="none").total is None


def test_to_double_refuses_what_is_not_finite(spark):
    assert [one(spark, V.to_double(F.col("v")), v=v) for v in (" 4.5 ", "NaN", "inf", "x")] == [4.5, None, None, None]


def test_tri_state(spark):
    assert [one(spark, V.tri_state(F.col("v")), v=v) for v in ("Yes", "0", "maybe")] == [True, False, None]


@pytest.mark.parametrize("key", ["plain", "café", "日本", "a🎬b", ""])
def test_fnv_over_code_points(spark, key):
    h = 2166136261
    for ch in key:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    assert one(spark, V.fnv1a32(F.col("v")), v=key) == h


def test_macros(spark):
    assert one(spark, V.macro_by_member(F.col("g"), K.MOVIE_MACROS), g="Drama|Sci-Fi") == "Sci-Fi/Fantasy"
    assert one(spark, V.macro_by_substring(F.col("g"), K.MUSIC_MACROS), g="Trap beats") == "Hip-Hop"
    assert one(spark, V.part_count(F.col("g")), g="") == 1


def test_parse_list(spark):
    parse = lambda v, d: sorted(one(spark, L.parse_list(F.col("v"), d), v=v))
    assert parse("Action|Sci-Fi|none", "movies") == ["action", "sci-fi"]
    assert parse("Italian, Pizza", "restaurants") == ["italian", "pizza"]
    assert parse("['Rock', \"Pop\"]", "music") == ["pop", "rock"]
    assert parse("dream pop", "music") == ["dream", "pop"]
    assert parse("(no genres listed)", "movies") == []


def test_jaccard_of_empty_is_null(spark):
    assert one(spark, L.jaccard(F.array().cast("array<string>"), F.array(F.lit("a"))), x=1) is None


def test_unit_keeps_zero(spark):
    assert one(spark, VX.unit(F.array(F.lit(0.0), F.lit(0.0))), x=1) == [0.0, 0.0]
    assert math.isclose(sum(x * x for x in one(spark, VX.unit(F.array(F.lit(3.0), F.lit(4.0))), x=1)), 1.0)


def test_vocabulary_counts():
    assert sum(2 if a[2] else 1 for a in K.FEEL_AXES) == 23 and len(K.FEEL_DIMENSIONS) == 13
