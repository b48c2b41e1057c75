"""Every query of the catalogue with its SQL."""

from __future__ import annotations

from . import demand_queries, panel_queries, stock_queries

QUERIES = {**demand_queries.QUERIES, **stock_queries.QUERIES, **panel_queries.QUERIES}
ORACLES = {**demand_queries.ORACLES, **stock_queries.ORACLES, **panel_queries.ORACLES}
