"""Registry of queries and of the SQL that each is held against."""

from __future__ import annotations

from corvane.plans import chunking, curation, dialogue, evaluation, ingestion, latency, retrieval  # noqa: F401
from corvane.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
