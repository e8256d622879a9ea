"""Delimited text to sets of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapwright.functions.constants import EMPTY_LIST_TOKENS
from mapwright.functions.text import clean_token, text_or_empty

QUOTED = r"\"[^\"]*\"|'[^']*'"

# Order in which delimiters are tried per domain.
DELIMITERS = {"movies": ["|", ","], "restaurants": [",", "|"], "music": ["|", ","]}


def parse_list(c: Column, domain: str) -> Column:
    """Distinct clean tokens of a list written as text.

    A bracketed list of quoted items gives the items, commas inside them kept; another
    bracketed list is split on its commas; otherwise the first delimiter the domain
    knows that occurs in the text decides; music without one falls back to words.
    """
    t = F.trim(text_or_empty(c))
    bracketed = t.startswith("[") & t.endswith("]")
    out = F.when(t.rlike(rf"^\[\s*(?:{QUOTED})(?:\s*,\s*(?:{QUOTED}))*\s*,?\s*\]$"), F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0)))
    out = out.when(bracketed, F.split(t, ","))
    for mark in DELIMITERS.get(domain, []):
        out = out.when(F.contains(t, F.lit(mark)), F.split(t, "\\" + mark))
    if domain == "music":
        pattern = F.lit(r"[a-zA-Z0-9][a-zA-Z0-9_\-']+")
        out = out.otherwise(F.regexp_extract_all(t, pattern, F.lit(0)))
    else:
        out = out.otherwise(F.array(t))
    drop = [""] + EMPTY_LIST_TOKENS
    return F.array_distinct(
        F.filter(F.transform(out, clean_token), lambda p: ~p.isin(drop)))


def parse_list_by_domain(c: Column, domain: Column) -> Column:
    out = F.when(domain == "restaurants", parse_list(c, "restaurants"))
    return out.when(domain == "music", parse_list(c, "music")).otherwise(parse_list(c, "movies"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets, null when either is empty."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both)
