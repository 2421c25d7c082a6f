"""Registered queries: every operator on the mapped driver tables."""
from quarterdeck.queries import (q_sources, q_upserts, q_relational, q_reconcile, q_lines, q_measures, q_scores, q_valuation, q_marts)  # noqa: F401
from quarterdeck.queries.registry import QUERIES as REGISTERED, check_sql as CHECKED

__all__ = ["REGISTERED", "CHECKED"]
