"""All queries by name, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from parlance.plans import conversations, files, reports, scoring, statistics, texts, timelines, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (conversations, timelines, texts, statistics, scoring, vectors, reports, files):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
