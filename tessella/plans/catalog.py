"""Named queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

from . import evaluation_queries, event_queries, feature_queries, fundamental_queries, look_queries, market_queries, panel_queries, pit_queries, quality_queries, signal_queries, text_graph_queries  # noqa: F401  (they register)
from .registry import QUERIES, SQL


def entry(spark, sf_dir):
    """Monthly rank IC of momentum: bars, features, month ends, ranks, correlation."""
    return evaluation_queries.monthly_ic(spark, sf_dir, min_names=8)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
