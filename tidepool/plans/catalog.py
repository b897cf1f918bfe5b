"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from . import q_core, q_files, q_runs, q_schema, q_sources, q_stream, q_writes  # noqa: F401
from .registry import ORACLE, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
