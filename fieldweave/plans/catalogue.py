"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from . import queries_graph, queries_io, queries_scores, queries_text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_scores, queries_text, queries_graph, queries_io):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
