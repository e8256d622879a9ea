"""Whole datasets: the single-domain, shared-text and shared-feel maps, details, naming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.functions import constants as K
from mapwright.functions import text as T
from mapwright.functions import values as V
from mapwright.operators import density, feel, fusion, naming, reduce
from mapwright.operators import prepare as P
from mapwright.operators.datasets import join_one_to_one
from mapwright.operators.ranking import percentile_size
from mapwright.sources.storage import scratch_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and go on from the written table."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fused_vectors(ids: DataFrame, pieces: DataFrame, reviews: DataFrame, share: float, stopwords: Sequence[str], components: int) -> DataFrame:
    """Text vectors reduced by SVD, joined by key with review vectors, fused side by side.

    ``ids`` lists the entities; ``pieces`` holds their texts as rows (id, text); ``reviews``
    has id and embedding. Missing blocks are zeros.
    """
    base, _ = reduce.embed_texts(pieces, ids, "id", "text", stopwords, components)
    second = reviews.select("id", F.col("embedding").cast("array<double>").alias("review_embedding"))
    size = second.agg(F.max(F.size("review_embedding"))).first()[0] or 1
    return fusion.concat_fusion_rows(base.join(second, "id", "left"), "id", "embedding", "review_embedding", size, share)


def lay_out(entities: DataFrame, vectors: DataFrame, min_cluster_size: int, min_samples: int, contrast: float = 1.0,
            words: DataFrame | None = None) -> DataFrame:
    """Positions, density clusters and region labels for the entities that have a vector.

    Labels are a row a cluster; they are written, as a bundle goes over the finished map four times.

    ``words`` (id, text) gives the labels where the entities carry no macro category.
    """
    placed = stored(entities.join(reduce.layout_2d(stored(vectors, "vectors"), "id"), "id"), "placed")
    clustered = stored(density.density_clusters(placed, min_cluster_size, min_samples, contrast), "clustered")
    described = clustered
    if words is not None:
        described = clustered.select("id", "cluster").join(words, "id", "left").select("cluster", F.col("text").alias("semantic_text"))
    return clustered.join(stored(naming.region_labels(described), "labels"), "cluster", "left")


def movie_entities(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rated movies with weighted rating, popularity and macro genre, sized.

    The statistics are written once: the prior, its weight and the ratings themselves come from one pass over the ratings.
    """
    rated = P.weighted_rating(stored(P.rating_stats(ratings), "rating-stats")).join(movies, "movie_id", "left")
    return percentile_size(rated.select(
        V.global_id(F.lit("movies"), F.col("movie_id")).alias("id"), F.lit("movies").alias("domain"),
        V.id_key(F.col("movie_id")).alias("source_id"), "title", "genres", "avg_rating", "rating_count", "weighted_rating",
        F.col("rating_count").cast("double").alias("popularity"),
        V.macro_by_member(F.col("genres"), K.MOVIE_MACROS).alias("macro_genre")))


def movie_pieces(tags: DataFrame) -> DataFrame:
    return tags.where("tag IS NOT NULL").select(V.global_id(F.lit("movies"), F.col("movie_id")).alias("id"), F.col("tag").alias("text"))


def artist_entities(artists: DataFrame, min_listeners: int = 1000) -> DataFrame:
    return percentile_size(P.filter_artists(artists, min_listeners).select(
        V.global_id(F.lit("music"), F.col("mbid")).alias("id"), F.lit("music").alias("domain"), F.col("mbid").alias("source_id"),
        F.coalesce(V.blank_to_null(F.col("artist_lastfm")), "artist_mb").alias("title"),
        F.coalesce(V.blank_to_null(F.col("country_lastfm")), "country_mb").alias("country"),
        V.artist_popularity(F.col("listeners"), F.col("scrobbles")).alias("popularity"),
        V.macro_by_substring(F.col("tags_lastfm"), K.MUSIC_MACROS).alias("macro_genre")))


def artist_pieces(artists: DataFrame) -> DataFrame:
    text = F.regexp_replace(T.text_or_empty(F.col("tags_lastfm")), ";", " ")
    return artists.select(V.global_id(F.lit("music"), F.col("mbid")).alias("id"), text.alias("text"))


def restaurant_entities(business: DataFrame, min_reviews: int = 20) -> DataFrame:
    return percentile_size(P.filter_restaurants(business, min_reviews).select(
        V.global_id(F.lit("restaurants"), F.col("business_id")).alias("id"), F.lit("restaurants").alias("domain"),
        F.col("business_id").alias("source_id"), F.col("name").alias("title"), "categories", "stars",
        F.col("review_count").cast("double").alias("popularity"),
        V.macro_by_substring(F.col("categories"), K.RESTAURANT_MACROS).alias("macro_genre")))


def restaurant_pieces(business: DataFrame, tips: DataFrame) -> DataFrame:
    gid = V.global_id(F.lit("restaurants"), F.col("business_id")).alias("id")
    own = business.where("categories IS NOT NULL").select(gid, F.col("categories").alias("text"))
    return own.unionByName(tips.select(gid, "text"))


def with_reviews(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """Entities with the number of reviews behind their vector."""
    counts = reviews.select("id", "review_count")
    return entities.drop("review_count").join(counts, "id", "left").na.fill(0, ["review_count"])


def domain_map(entities: DataFrame, pieces: DataFrame, reviews: DataFrame, stopwords: Sequence[str], share: float = 0.5,
               components: int = 256, min_cluster_size: int = 150, min_samples: int = 20) -> DataFrame:
    """Single-domain map from the entities' texts and review vectors (id, embedding, review_count)."""
    reviews = stored(reviews, "reviews")
    entities = stored(with_reviews(entities, reviews), "entities")
    texts = pieces.join(entities.select("id"), "id", "left_semi")
    vectors = fused_vectors(entities.select("id"), texts, reviews, share, stopwords, components)
    return lay_out(entities, vectors, min_cluster_size, min_samples)


def shared_words(pieces: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Each cleaned word of each entity once, the domains' own vocabulary left out."""
    vocabulary = [w for d in domains for w in K.DOMAIN_VOCABULARY[d]]
    texts = pieces.select("id", "text").distinct()
    found = texts.select("id", F.explode(T.label_words(F.col("text"))).alias("text")).distinct()
    return found.where(~F.col("text").isin(vocabulary))


def shared_text_map(parts: dict[str, DataFrame], pieces: DataFrame, reviews: DataFrame, stopwords: Sequence[str], share: float = 0.5,
                    components: int = 256, min_cluster_size: int = 150, min_samples: int = 20) -> DataFrame:
    """Several domains on one map: domain words removed, each word once, sizes kept from
    the domain, no macro category (labels come from the shared text)."""
    union = None
    for part in parts.values():
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    reviews = stored(reviews, "reviews")
    entities = stored(with_reviews(union.drop("macro_genre"), reviews), "entities")
    words = stored(shared_words(pieces, list(parts)).join(entities.select("id"), "id", "left_semi"), "words")
    vectors = fused_vectors(entities.select("id"), words, reviews, share, stopwords, components)
    return lay_out(entities, vectors, min_cluster_size, min_samples, words=words)


def feel_map(entities: DataFrame, scores: DataFrame, expected: dict[str, int] | None = None,
             min_cluster_size: int = 150, min_samples: int = 20) -> DataFrame:
    """Map of the semantically defined entities by their standardised feel scores."""
    defined = scores.where("is_semantically_defined").select("id", *K.FEEL_DIMENSIONS)
    joined = stored(join_one_to_one(entities, defined, ["id"]), "scored")
    if expected is not None:
        found = {r["domain"]: r["count"] for r in joined.groupBy("domain").count().collect()}
        if found != expected:
            raise ValueError(f"population {found} is not the expected {expected}")
    z = feel.standardise(joined, joined)
    vectors = z.select("id", F.array(*[f"feel_z_{d}" for d in K.FEEL_DIMENSIONS]).alias("embedding"))
    return lay_out(z.drop(*K.FEEL_DIMENSIONS), vectors, min_cluster_size, min_samples)
