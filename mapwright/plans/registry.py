"""Registry of checked queries: a name, a Spark plan and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapwright.plans.fixtures import TIE_SHIFT, Tables, with_fixtures

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is its reference result."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = with_fixtures(sql)
        return fn

    return wrap


def r6(c: Column | str) -> Column:
    """Double rounded to six digits, the precision results are compared at.

    Sums of doubles depend on their order in the last bits; the small shift keeps values
    that lie exactly between two roundings from falling to either side by chance.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + TIE_SHIFT, 6)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
