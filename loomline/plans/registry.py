"""All queries of the engine, with the same rows in SQL where SQL can say them."""

from __future__ import annotations

from . import analytics, extraction, payloads, sites, web

QUERIES = {**analytics.QUERIES, **web.QUERIES, **extraction.QUERIES, **payloads.QUERIES, **sites.QUERIES}
SQL = {**analytics.SQL, **web.SQL, **extraction.SQL, **payloads.SQL, **sites.SQL}
