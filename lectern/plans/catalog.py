"""All queries but those of the subpackage for training data."""

from lectern.plans import copies, engagement, feed, ingest, library, searches, serving, streams, sync, texts, whole, worklist  # noqa: F401  (they register their queries)
from lectern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
