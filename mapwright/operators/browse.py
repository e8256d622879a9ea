"""The map client's filters and look-ups as batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.functions.text import search_key


def domain_filter(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Rows of the chosen domains; choosing none means all."""
    return df.where(F.col("domain").isin(list(domains))) if domains else df


def has_reviews(flag: Column, count: Column, stored: Column | None = None) -> Column:
    """Review vector used, reviews counted, or review texts stored."""
    out = F.coalesce(flag, F.lit(False)) | (F.coalesce(count, F.lit(0)) > 0)
    return out if stored is None else out | (F.size(stored) > 0)


def focus_box(df: DataFrame, match: Column, half: float = 1.5) -> DataFrame:
    """Items strictly inside a box around the first match by id."""
    centre = df.where(match).agg(F.min_by(F.struct("x", "y"), "id")).scalar()
    out = df.withColumn("_c", centre)
    inside = (F.abs(F.col("x") - F.col("_c.x")) < half) & (F.abs(F.col("y") - F.col("_c.y")) < half)
    return out.where(inside).drop("_c")


def title_search(df: DataFrame, text: str, importance: Column, limit: int = 10) -> DataFrame:
    """First ten titles holding the text, most important first; needs two characters."""
    if len(text.strip()) < 2:
        return df.limit(0)
    hit = F.lower("title").contains(text.strip().lower())
    return df.where(hit).orderBy(importance.desc_nulls_last(), "id").limit(limit)


def resolve_names(names: DataFrame, items: DataFrame, defined: Column, title: str = "title") -> DataFrame:
    """Best item per queried name: same key first, else a key holding it; defined items
    first, then by id.

    Substrings are found through an equi join on one run of letters of the query, the one that
    the fewest titles hold, so a query with a common beginning meets few titles and no list of
    names has to fit in memory.
    """
    queries = names.select("name", search_key(F.col("name")).alias("query_key")).where("length(query_key) >= 2").distinct()
    keyed = items.withColumn("item_key", search_key(F.col(title))).withColumn("_defined", F.coalesce(defined, F.lit(False)))
    # Titles repeat: per key only the best item can ever be the answer.
    best = keyed.groupBy("item_key").agg(
        F.min(F.struct((~F.col("_defined")).alias("undefined"), F.col("id").alias("id"))).alias("best"))
    exact = queries.join(best, queries.query_key == best.item_key).select("name", F.lit(0).alias("level"), "best")
    rest = queries.join(best, queries.query_key == best.item_key, "left_anti")
    starts = F.sequence(F.lit(1), F.length("item_key") - 1)
    grams = F.array_distinct(F.concat(
        F.transform(starts, lambda i: F.substring(F.col("item_key"), i, F.lit(2))),
        F.transform(starts, lambda i: F.substring(F.col("item_key"), i, F.lit(3)))))
    runs = best.where("length(item_key) >= 2").select("item_key", "best", F.explode(grams).alias("gram"))
    width = F.least(F.length("query_key"), F.lit(3))
    own = F.transform(F.sequence(F.lit(1), F.length("query_key") - width + 1), lambda i: F.substring(F.col("query_key"), i, width))
    asked = rest.select("name", "query_key", F.explode(F.array_distinct(own)).alias("gram"))
    used = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = asked.join(used, "gram", "left").groupBy("name", "query_key").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    part = rare.join(runs, "gram").where(
        F.col("item_key").contains(F.col("query_key"))).select("name", F.lit(1).alias("level"), "best")
    hits = exact.unionByName(part).groupBy("name").agg(F.min(F.struct("level", "best")).alias("hit"))
    return hits.select("name", F.col("hit.best.id").alias("id"), F.col("hit.level").alias("level"))


def resolution_rate(resolved: DataFrame, names: DataFrame, group: str) -> DataFrame:
    """Share of names per group that found an item."""
    both = names.join(resolved.select("name", "id"), "name", "left")
    return both.groupBy(group).agg(
        F.count(F.lit(1)).alias("names"), F.count("id").alias("resolved"),
        (F.count("id") / F.count(F.lit(1))).alias("rate"))


def available_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def named_profiles(names: DataFrame, items: DataFrame, defined: Column, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of the item each name resolves to."""
    hits = resolve_names(names, items, defined).select("name", "id")
    return hits.join(items.select("id", *columns), "id")


