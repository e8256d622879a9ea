"""Casts, flags, keys and hashes as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_double(c: Column) -> Column:
    """Finite double or null."""
    return finite(F.trim(c.cast("string")).try_cast("double"))


def to_int(c: Column) -> Column:
    """Whole part of the number as a 64-bit integer, null when it is none or does not fit.

    Whole numbers go straight to integers, so no digit is lost on the way.
    """
    t = F.trim(c.cast("string"))
    d = to_double(c)
    return F.coalesce(t.try_cast("bigint"), F.when(F.abs(d) < 9.2e18, d).cast("bigint"))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def empty_to_null(c: Column) -> Column:
    """Null for empty text only; blanks count as text and stay."""
    return F.when(c != "", c)


def zero_to_null(c: Column) -> Column:
    return F.when(c != 0, c)


def id_key(c: Column, variant: str = "text") -> Column:
    """Text key of an id; nulls become blank.

    ``variant``: 'trim' takes the text as it is, 'typed' also writes whole floats without decimals or exponent, 'text'
    does so for texts such as "12.0" too.
    """
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    if variant == "trim":
        return t
    # The type is known when the plan is made, so this test costs nothing.
    number = c.try_cast("double")
    whole = F.typeof(c).isin("double", "float") & (F.floor(number) == number) & (F.abs(number) < 9.2e18)
    typed = F.when(whole, number.try_cast("bigint").cast("string"))
    integral = F.typeof(c).isin("tinyint", "smallint", "int", "bigint")
    decimals = ~integral & t.contains(".0")
    rest = F.when(decimals, F.regexp_replace(t, r"^([+-]?\d+)\.0+$", "$1")).otherwise(t) if variant == "text" else t
    return F.coalesce(typed, rest)


def global_id(domain: Column, source_id: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(domain)), id_key(source_id))


def within(c: Column, low: float, high: float) -> Column:
    """The number when it lies in the closed range, else null."""
    v = to_double(c)
    return F.when(v.between(low, high), v)


def flag_from_number(c: Column) -> Column:
    return F.coalesce((to_double(c) > 0).cast("int"), F.lit(0))


def flag_from_text(c: Column, true_words: Sequence[str] = ("true", "1", "yes")) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(list(true_words)), F.lit(False))


def tri_state(
    c: Column,
    true_words: Sequence[str] = ("true", "1", "yes", "y", "t"),
    false_words: Sequence[str] = ("false", "0", "no", "n", "f"),
) -> Column:
    """True, false, or null for text that says neither."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(list(true_words)), True).when(t.isin(list(false_words)), False)


def helpful_votes(c: Column) -> Column:
    """Struct yes, total, ratio out of text such as "3, 7"."""
    pattern = r"""["']?(\d+)["']?\s*,\s*["']?(\d+)"""
    yes = F.regexp_extract(c, pattern, 1).try_cast("bigint")
    total = F.regexp_extract(c, pattern, 2).try_cast("bigint")
    return F.struct(
        yes.alias("yes"), total.alias("total"), F.when(total > 0, yes / total).alias("ratio")
    )


def fnv1a32(c: Column) -> Column:
    """32-bit FNV-1a over code points."""
    points = F.transform(F.filter(F.split(c, ""), lambda s: s != ""), code_point)
    return F.aggregate(
        points,
        F.lit(2166136261).cast("bigint"),
        lambda h, p: (h.bitwiseXOR(p) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)),
    )


def code_point(ch: Column) -> Column:
    """Code point of a one-character text."""
    return F.ascii(ch).cast("bigint")


def shard_of(c: Column, shards: int = 256) -> Column:
    return (fnv1a32(c) % shards).cast("int")


def sample_score(seed: int | str, *keys: Column) -> Column:
    """Repeatable, evenly spread text score; the smallest scores form a sample."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def bayes_rating(rating: Column, votes: Column, prior: Column, weight: Column) -> Column:
    return (rating * votes + prior * weight) / (votes + weight)


def artist_popularity(listeners: Column, plays: Column) -> Column:
    return F.log1p(listeners) * 0.6 + F.log1p(plays) * 0.4


def macro_by_member(genres: Column, groups) -> Column:
    """First group that owns one of the pipe-separated genres."""
    parts = F.split(F.trim(genres), r"\|")
    out = F.when(genres.isNull(), "Unknown")
    for name, members in groups:
        out = out.when(F.arrays_overlap(parts, F.array(*[F.lit(m) for m in members])), name)
    return out.otherwise("Other")


def macro_by_substring(text: Column, groups) -> Column:
    """First group with a word contained in the text."""
    low = F.lower(text)
    out = F.when(text.isNull(), "Other")
    for name, needles in groups:
        out = out.when(low.rlike("|".join(needles)), name)
    return out.otherwise("Other")


def part_count(genres: Column) -> Column:
    return F.size(F.split(F.coalesce(genres, F.lit("")), r"\|"))


def signed_text(z: Column) -> Column:
    return F.format_string("%+.2fσ", z)
