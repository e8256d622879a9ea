"""Bounded samples compared with themselves, block by block.

Quality metrics look at every pair of a sample whose size has a hard upper limit. Query
blocks are spread over tasks, each with a copy of the sample; the pairs live as NumPy
arrays inside a task and only per-query results leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.sources.storage import spread

MAX_SAMPLE = 30000
BLOCK_ROWS = 256


def per_query_block(
    sample: DataFrame, limit: int, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    queries: DataFrame | None = None, key: str = "id",
) -> DataFrame:
    """Run ``kernel(queries, sample)`` per block of queries; ``limit`` caps the sample.

    ``sample`` must hold at most ``limit`` rows; a larger one raises in the task.
    """
    if limit > MAX_SAMPLE:
        raise ValueError(f"samples are limited to {MAX_SAMPLE} rows")
    blocks = max(1, -(-limit // BLOCK_ROWS))
    ask = sample if queries is None else queries
    q = ask.select(F.lit(True).alias("is_query"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *sample.columns)
    r = sample.select(F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), *sample.columns)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks, refs = group[group["is_query"]], group[~group["is_query"]]
        if len(refs) > limit:
            raise ValueError(f"sample of {len(refs)} rows exceeds its limit {limit}")
        if not len(asks):
            return kernel(asks, refs.iloc[:0])
        order = refs[key].map(str).argsort(kind="stable")
        return kernel(asks, refs.iloc[order])

    return spread(q.unionByName(r), "block").groupBy("block").applyInPandas(run, schema)


def matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1)


def squared_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Differences are squared and summed one by one, as exact ties need it."""
    out = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        gap = q[:, j][:, None] - r[:, j][None, :]
        out += gap * gap
    return out


def order_without_self(d: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Row-wise order by value, ties by id (columns come sorted by id), self last."""
    d = d.copy()
    d[np.nonzero(own >= 0)[0], own[own >= 0]] = np.inf
    return np.argsort(d, axis=1, kind="stable")
