"""Scalar functions and user-defined functions."""

from . import scalar, text, udfs  # noqa: F401
