"""The record-linkage queries and their SQL, by name (filled by the modules of ``plans``)."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
