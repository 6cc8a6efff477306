"""Every query of the relational surface by name, with the SQL that checks it."""

from __future__ import annotations

from lumenframe.plans import aggregates, complex_types, io_queries, joins, reports, scalars, sets_and_sorts, streams, udf_queries, windows  # noqa: F401
from lumenframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
