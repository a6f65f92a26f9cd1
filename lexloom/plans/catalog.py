"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from lexloom.plans import document_queries, retrieval_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **document_queries.QUERIES, **retrieval_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **document_queries.ORACLES, **retrieval_queries.ORACLES}
