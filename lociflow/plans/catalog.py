"""Named queries over the library's operators, with their SQL."""

from __future__ import annotations

from lociflow.plans import boundary_queries, cleaning_queries, fragment_queries, graph_queries, locus_queries, route_queries, structure_queries, transcript_queries
from lociflow.plans.locus_queries import locus_summary  # noqa: F401

ALL = {**locus_queries.QUERIES, **fragment_queries.QUERIES, **graph_queries.QUERIES, **cleaning_queries.QUERIES, **boundary_queries.QUERIES, **structure_queries.QUERIES, **route_queries.QUERIES, **transcript_queries.QUERIES}


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
