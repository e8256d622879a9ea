"""Repeatable samples by hashed id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.functions.values import sample_score
from mapwright.operators.ranking import top_per_group


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with the smallest scores; every task keeps its best ``n`` only."""
    return df.withColumn("_s", sample_score(seed, F.col(key))).orderBy("_s", key).limit(n).drop("_s")


def sample_per_class(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per label."""
    order = [sample_score(seed, F.col(key)), F.col(key)]
    return top_per_group(df, [label], order, n, "_r").drop("_r")


def evaluation_sample(df: DataFrame, key: str, eligible: Column, n: int = 3000, seed: int = 42) -> DataFrame:
    return sample(df.where(eligible), key, n, seed)
