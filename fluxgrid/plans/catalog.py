"""The queries of the library and the SQL they are held against."""

from __future__ import annotations

from fluxgrid.plans import chat, checks, graph, mapping, quality, retrieval, series, streams, text  # noqa: F401
from fluxgrid.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
