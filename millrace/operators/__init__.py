"""Relational operators."""

from . import aggregates, funnels, heavy_hitters, joins, projections, prefix_sums, ranges, recursion, selection, sets, vector_index, vectors, windows  # noqa: F401
