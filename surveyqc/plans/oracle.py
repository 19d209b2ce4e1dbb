"""The SQL of the registered queries."""

from surveyqc.plans.queries import SQL

__all__ = ["SQL"]
