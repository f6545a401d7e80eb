"""Registered queries and their SQL."""

from __future__ import annotations

from tidemark.plans import decisions, market, reports, research, stores, studies  # noqa: F401  all add their queries to the registry of market

flagship = market.flagship


def queries() -> dict:
    return dict(market.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(market.SQL)
