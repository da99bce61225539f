"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from quorix.plans.oracles import ORACLES
from quorix.plans.queries import QUERIES

FLAGSHIP = "knn_bucket_exact"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
