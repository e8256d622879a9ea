"""All registered queries; importing the parts fills the registry."""

from __future__ import annotations

from mapwright.plans import (  # noqa: F401
    q_aggregates,
    q_datasets,
    q_domains,
    q_export,
    q_metrics,
    q_prepare,
    q_ranking,
    q_scalars,
    q_space,
    q_streams,
    q_vectors,
    registry,
)


def queries():
    return registry.all_queries()


def oracle_sql():
    return registry.all_oracles()
