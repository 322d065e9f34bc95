"""All queries of the volumetric part, by name."""

from __future__ import annotations

from voxloom.plans import file_queries, graph_queries, grid_queries, metric_queries, voxel_queries

MODULES = (metric_queries, voxel_queries, grid_queries, graph_queries, file_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
