"""All queries of the core library; importing the families registers them."""

from seqlab.plans import query_labels, query_sessions, query_sources, query_stats, query_vectors  # noqa: F401
from seqlab.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
