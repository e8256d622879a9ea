"""Text to vectors: choose reviews, encode them, pool them per entity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.functions import values as V
from mapwright.operators.fusion import mean_pool
from mapwright.operators.ranking import top_per_group

ENCODED_PER_ENTITY = 50


def hashed_terms(df: DataFrame, text: str, size: int = 256) -> DataFrame:
    """Default encoder: hashed term counts of length one, computed in the JVM."""
    tokens = df.withColumn("_tokens", T.term_tokens(F.col(text)))
    counts = HashingTF(numFeatures=size, inputCol="_tokens", outputCol="_tf").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counts)
    return unit.withColumn("embedding", vector_to_array("_unit")).drop("_tokens", "_tf", "_unit")


def encode_with(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Run any batch encoder over Arrow batches; one model load per task is the encoder's affair."""
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = encoder(batch[text].tolist())
            yield batch.assign(embedding=[np.asarray(v, dtype="float64") for v in vectors])

    return df.mapInPandas(run, f"{fields}, embedding array<double>")


def select_reviews(reviews: DataFrame, entity: str = "entity_id", n: int | None = ENCODED_PER_ENTITY, seed: int = 42) -> DataFrame:
    """The ``n`` reviews of each entity with the smallest hash, chosen before blanks go; all of them with None."""
    if n is None:
        return reviews
    order = [V.sample_score(seed, F.col("review_id")), F.col("review_id")]
    return top_per_group(reviews, [entity], order, n, "_r").drop("_r")


def review_embeddings(reviews: DataFrame, entity: str = "entity_id", n: int | None = ENCODED_PER_ENTITY, seed: int = 42,
                      encoder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Mean review vector of every entity from its chosen, non-blank reviews."""
    chosen = select_reviews(reviews, entity, n, seed).where(T.collapse_spaces(F.col("review_text")) != "")
    encoded = hashed_terms(chosen, "review_text") if encoder is None else encode_with(chosen, "review_text", encoder)
    return mean_pool(encoded, entity)


def entity_embeddings(entities: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Vector of every entity's own text with its length and whether there was any."""
    clean = entities.withColumn("clean_text", T.collapse_spaces(F.col(text)))
    encoded = hashed_terms(clean, "clean_text") if encoder is None else encode_with(clean, "clean_text", encoder)
    return encoded.withColumn("has_base_semantics", F.col("clean_text") != "").withColumn(
        "text_length", F.length("clean_text"))
