"""Registered queries over the test tables and their independent SQL."""

from checks import fact_queries, report_queries, rollup_queries, scalars_joins, sources_filters, store_queries  # noqa: F401  (they fill the registry)
from checks.base import REGISTRY, frames_for

__all__ = ["REGISTRY", "frames_for"]
