"""Nested map documents: items, regions, landmarks, and JSON-safe values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from mapwright.functions.values import empty_to_null, finite, zero_to_null


def display_title(*candidates: Column) -> Column:
    return F.coalesce(*[empty_to_null(c) for c in candidates], F.lit("Unknown"))


def first_nonzero(*candidates: Column) -> Column:
    """A zero counts as missing and gives way to the next candidate."""
    return F.coalesce(*[zero_to_null(c) for c in candidates])


def category_list(*candidates: Column) -> Column:
    return F.array_compact(F.array(F.coalesce(*[empty_to_null(c) for c in candidates])))


def feature_description(**flags: Column) -> Column:
    return F.concat_ws("+", *[F.when(flag, name) for name, flag in flags.items()])


def _pick(df: DataFrame, kind: str, *names: str) -> list[Column]:
    found = [F.col(n).cast(kind) for n in names if n in df.columns]
    return found or [F.lit(None).cast(kind)]


def item_struct(df: DataFrame, map_domain: str) -> DataFrame:
    """One nested document per entity; columns that do not exist become nulls."""
    source = F.coalesce(*_pick(df, "string", "source_id", "movieId", "business_id", "mbid"), F.lit(""))
    tags = F.array_compact(F.array(empty_to_null(_pick(df, "string", "tags_text")[0])))
    used = F.coalesce(_pick(df, "int", "reviews_used_for_embedding", "review_count")[0], F.lit(0))
    reviews = F.coalesce(_pick(df, "int", "review_count")[0], F.lit(0))
    metadata = [
        F.coalesce(*_pick(df, kind, name)).alias(alias)
        for alias, name, kind in (
            ("year", "year", "int"), ("country", "country", "string"),
            ("artist", "artist_lastfm", "string"), ("album", "album", "string"),
            ("address", "address", "string"), ("city", "city", "string"),
            ("latitude", "latitude", "double"), ("longitude", "longitude", "double"))
    ]
    return df.select(
        F.coalesce(*_pick(df, "string", "id"), source).alias("id"),
        source.alias("source_id"),
        display_title(*_pick(df, "string", "title", "artist_lastfm", "name")).alias("title"),
        F.coalesce(*_pick(df, "string", "domain"), F.lit(map_domain)).alias("domain"),
        F.struct(*metadata).alias("metadata"),
        F.struct(
            tags.alias("tags"),
            category_list(*_pick(df, "string", "genres", "categories", "macro_genre")).alias("categories"),
        ).alias("text"),
        F.struct(
            first_nonzero(*_pick(df, "double", "avg_rating", "rating", "stars")).alias("rating"),
            first_nonzero(*_pick(df, "bigint", "rating_count", "review_count")).alias("rating_count"),
            first_nonzero(*_pick(df, "double", "popularity", "popularity_score")).alias("popularity"),
        ).alias("statistics"),
        F.struct(
            F.coalesce(*_pick(df, "double", "x"), F.lit(0.0)).alias("x"),
            F.coalesce(*_pick(df, "double", "y"), F.lit(0.0)).alias("y"),
        ).alias("position"),
        F.struct(
            F.coalesce(*_pick(df, "double", "visual_size"), F.lit(1.0)).alias("size"),
            F.coalesce(*_pick(df, "int", "cluster"), F.lit(-1)).alias("cluster"),
            F.coalesce(*_pick(df, "string", "cluster_label")).alias("cluster_label"),
        ).alias("visual"),
        F.create_map(
            F.lit("review_count"), reviews.cast("string"),
            F.lit("reviews_used_for_embedding"), used.cast("string"),
            F.lit("has_review_embedding"), (used > 0).cast("string"),
        ).alias("enrichment"),
    )


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null, at any depth."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _safe(c: Column, kind: S.DataType) -> Column:
    if isinstance(kind, (S.DoubleType, S.FloatType)):
        return finite(c)
    if isinstance(kind, S.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, S.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, kind.valueType))
    if isinstance(kind, S.StructType):
        inner = F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    return c


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    """One JSON text per row, null fields kept."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def shard_sizes(df: DataFrame, domain: str, key: str, shards: int = 256) -> DataFrame:
    """Documents per (domain, shard) with a row for every shard, also empty ones."""
    from mapwright.functions.values import shard_of

    counts = df.groupBy(F.col(domain), shard_of(F.col(key), shards).alias("shard")).count()
    grid = df.select(domain).distinct().select(
        domain, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return grid.join(counts, [domain, "shard"], "left").na.fill(0, ["count"])


def regions(df: DataFrame) -> DataFrame:
    """Centre, mean size, label and member count of every cluster, noise included."""
    return df.groupBy("cluster").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("visual_size").alias("visual_size"),
        F.min("cluster_label").alias("cluster_label"), F.count("id").alias("member_count"))
