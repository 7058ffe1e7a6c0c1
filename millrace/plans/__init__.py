"""Whole queries: the decision-support queries that the tables allow."""

from . import decision_support  # noqa: F401
