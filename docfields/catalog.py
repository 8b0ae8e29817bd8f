"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from docfields.plans import composite_queries, field_queries, section_queries, source_queries, spatial_queries, text_queries, workspace_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (field_queries, spatial_queries, text_queries, workspace_queries, source_queries, section_queries, composite_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
