"""Named queries over the tables at hand."""

from cohortforge.plans import analysis, audited, cohort_tables, fitted, relational, refitted, studies  # noqa: F401
from cohortforge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
