"""All queries of the engine and their SQL."""

from millrace.plans import queries_documents, queries_ingest, queries_knowledge, queries_published, queries_search, queries_states, queries_tables  # noqa: F401  they register on import
from millrace.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
