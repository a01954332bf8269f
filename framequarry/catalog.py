"""All queries of the core library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .plans import catalogue_queries, identity_queries, job_queries, playback_queries, policy_queries, section_queries, series_queries, storage_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (identity_queries, catalogue_queries, section_queries, series_queries, playback_queries, storage_queries, job_queries, policy_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
