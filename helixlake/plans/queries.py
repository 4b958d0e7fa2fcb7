"""All queries of the library. Importing the query modules registers them."""

from helixlake.plans import q_quality, q_sources, q_strands, q_wetlab  # noqa: F401
from helixlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
