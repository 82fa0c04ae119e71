"""All registered raster queries: plans in PySpark and their DuckDB SQL."""

from __future__ import annotations

from prismgrid.catalog import aggregates, capture, composites, joins, maps, plain, sinks, streams, windows

FLAGSHIP = "c12_finish_default"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (maps, windows, aggregates, joins, composites, streams, sinks, capture):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
ORACLE_SQL |= plain.SQL  # written by hand, in place of the expressions that the plans run
