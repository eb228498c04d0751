"""All queries of the library outside the training-data operators, with their SQL."""

from __future__ import annotations

from . import evaluation, feeds, graph, hybrid, ingest, reports, runs, search, tiered, writes

MODULES = (graph, search, hybrid, reports, ingest, writes, evaluation, feeds, runs, tiered)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: text for m in MODULES for name, text in m.SQL.items()}
