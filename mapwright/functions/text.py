"""Text cleaning and keys as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What titles lose before they are compared. Their order decides which titles are linked.
CLOSING_YEAR = r"\s*\(\d{4}\)\s*$"
CLOSING_YEARS = r"\s*\(\d{4}(?:\s*[-–—]\s*\d{0,4})?\)\s*$"
CLOSING_NUMERAL = r"(?i)\s+\([ivxlcdm]+\)\s*$"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Every run of Unicode white space becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(text_or_empty(c)))


def year_in_title(title: Column) -> Column:
    """Year written in brackets, null when there is none."""
    return F.nullif(F.regexp_extract(title, r"\((\d{4})\)", 1), F.lit("")).cast("int")


def first_year(title: Column) -> Column:
    """First run of four digits, wherever it stands."""
    return F.nullif(F.regexp_extract(title, r"(\d{4})", 1), F.lit("")).cast("int")


def strip_title_year(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, CLOSING_YEAR, ""))


def strip_review_title(title: Column) -> Column:
    """Drop a closing year or year range, then a closing roman numeral."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(title), CLOSING_YEARS, ""), CLOSING_NUMERAL, ""))


def match_key(title: Column) -> Column:
    """Title key for exact linkage."""
    t = F.lower(F.trim(text_or_empty(title)))
    t = F.translate(t, "–—−’‘“”", "---''\"\"")
    t = F.regexp_replace(t, "&", "and")
    t = F.regexp_replace(t, CLOSING_NUMERAL, "")
    t = F.regexp_replace(t, r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without its combining marks."""
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def strip_accents(c: Column) -> Column:
    """Letters without accents, in any script. Spark has no function for it, so texts go to Python in Arrow batches."""
    return _decomposed(text_or_empty(c))


def search_key(title: Column) -> Column:
    """Accent-free lower-case key for looking a name up. Call it on distinct titles where titles repeat."""
    t = F.regexp_replace(text_or_empty(title), CLOSING_YEAR, "")
    return F.trim(F.regexp_replace(F.lower(strip_accents(t)), r"[^a-z0-9]+", " "))


def label_text(c: Column) -> Column:
    t = F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9\s\-]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def label_words(c: Column) -> Column:
    """The words of ``label_text`` and of ``semantic_text``, found in one pass over the text."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[a-z0-9\-]+"), F.lit(0))


def semantic_text(*parts: Column) -> Column:
    """Join descriptive parts into one cleaned lower-case text."""
    joined = F.concat_ws(" ", *[text_or_empty(p) for p in parts])
    return label_text(F.translate(joined, ";|,", "   "))


def drop_words(text: Column, vocabulary: Sequence[str]) -> Column:
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    return F.array_join(F.filter(words(text), lambda w: ~F.array_contains(vocab, w)), " ")


def first_occurrences(text: Column) -> Column:
    return F.array_join(F.array_distinct(words(text)), " ")


def is_vocabulary_word(word: Column, vocabulary: Sequence[str]) -> Column:
    return F.lower(F.trim(word)).isin(list(vocabulary))


def review_body(summary: Column, detail: Column) -> Column:
    parts = F.array(F.trim(text_or_empty(summary)), F.trim(text_or_empty(detail)))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def clean_token(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.regexp_replace(t, r"^[ '\"\[\](){}]+|[ '\"\[\](){}]+$", "")


def naming_tokens(text: Column, stopwords: Sequence[str]) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z][A-Za-z\-']{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stopwords)))


def term_tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def split_categories(c: Column, delimiter: str = r"\|") -> Column:
    """Trimmed, non-blank, distinct parts in first-seen order."""
    parts = F.transform(F.split(text_or_empty(c), delimiter), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))
