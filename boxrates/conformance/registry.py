"""All registered queries and their SQL, by name."""

from __future__ import annotations

from boxrates.conformance import market, oracles, queries

QUERIES: dict[str, queries.Query] = {**queries.QUERIES, **market.QUERIES}
ORACLES: dict[str, str] = {**oracles.ORACLES, **market.ORACLES}
