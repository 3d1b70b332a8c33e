"""All queries of the engine over the shared tables, and the same in SQL."""

from __future__ import annotations

from earshot.plans import market_queries, page_queries, signal_queries

QUERIES = {**signal_queries.Q, **page_queries.Q, **market_queries.Q}
ORACLES: dict[str, str] = {**signal_queries.SQL, **page_queries.SQL, **market_queries.SQL}
