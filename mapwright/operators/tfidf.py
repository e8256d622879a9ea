"""Term weights of texts in long form: one row per (id, term).

The text of an id may be spread over any number of rows (its tags or tips, say): counts
add up the same, and no group of texts is ever put together into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapwright.functions.text import term_tokens


def term_counts(docs: DataFrame, key: str, text: str, stopwords: Sequence[str]) -> DataFrame:
    """Occurrences per (id, term); summed inside each task before the shuffle."""
    words = docs.select(key, F.explode(term_tokens(F.col(text))).alias("term"))
    if stopwords:
        words = words.where(~F.col("term").isin(list(stopwords)))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(counts: DataFrame, ids: DataFrame, limit: int | None) -> DataFrame:
    """The terms with their inverse document frequency: the ``limit`` most used ones, or all with None.

    ``counts`` comes from :func:`term_counts`; ``ids`` lists every id once, also those
    without a single term.
    """
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("uses"), F.count(F.lit(1)).alias("df"))
    rows = ids.agg(F.count(F.lit(1))).scalar()
    top = per_term if limit is None else per_term.orderBy(F.desc("uses"), "term").limit(limit)
    return top.withColumn("idf", F.log((rows + 1) / (F.col("df") + 1)) + 1)


def transform(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Weight per (id, term), every id's weights scaled to length one.

    Whether the vocabulary is broadcast is left to Spark, which knows its size.
    """
    raw = counts.join(vocabulary.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / length).alias("weight"))


def sparse_rows(weights: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """One row per id: sorted term positions and weights (never more than the vocabulary)."""
    place = vocabulary.select("term", "position")
    pairs = weights.join(place, "term").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("position", "weight"))).alias("p"))
    return pairs.select(
        key, F.transform("p", lambda r: r["position"]).alias("positions"), F.transform("p", lambda r: r["weight"]).alias("weights"))
