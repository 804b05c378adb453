"""Registered queries of the engine and the SQL each is checked against."""

from __future__ import annotations

from .plans import frames, reports, search

QUERIES: dict = {**search.QUERIES, **frames.QUERIES}
ORACLES: dict[str, str] = {**search.ORACLES, **reports.ORACLES}
