"""Structured Streaming."""

from . import events, stateful  # noqa: F401
