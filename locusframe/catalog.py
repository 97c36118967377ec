"""Registered queries and their SQL twins."""

from __future__ import annotations

from .plans import reads, search, stored

QUERIES: dict = {**search.QUERIES, **reads.QUERIES, **stored.QUERIES}
ORACLES: dict = {**search.ORACLES, **reads.ORACLES, **stored.ORACLES}
