"""Registered queries and the SQL they must agree with."""

from sparkmart.queries import changes, drifts, listings, marts, scalars
from sparkmart.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "changes", "drifts", "listings", "marts", "scalars"]
