"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

from ledgerlark.plans import (
    answer_queries,
    batch_queries,
    cleaning_queries,
    ingest_queries,
    metric_queries,
    question_queries,
)

_AREAS = (
    cleaning_queries,
    ingest_queries,
    metric_queries,
    batch_queries,
    question_queries,
    answer_queries,
)

QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
