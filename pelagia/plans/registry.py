"""All catalog queries with the SQL that checks them."""

from __future__ import annotations

from pelagia.plans import catalog_queries, curation_queries, record_queries, search_queries, stream_queries

QUERIES: dict = {**catalog_queries.QUERIES, **curation_queries.QUERIES, **record_queries.QUERIES, **search_queries.QUERIES, **stream_queries.QUERIES}
ORACLE_SQL: dict = {**catalog_queries.ORACLE_SQL, **curation_queries.ORACLE_SQL, **record_queries.ORACLE_SQL, **search_queries.ORACLE_SQL, **stream_queries.ORACLE_SQL}
