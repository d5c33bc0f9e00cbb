"""The queries of the core and their SQL."""

from scholarmill.plans import corpus_queries, retrieval_queries, source_queries, text_queries  # noqa: F401
from scholarmill.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
