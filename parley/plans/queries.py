"""All registered queries of this package but those of the optional corpus subpackage."""

from parley.plans import contact_queries, hotspot_queries, stream_queries  # noqa: F401  (importing registers them)
from parley.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
