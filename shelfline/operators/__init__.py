"""Reusable DataFrame operators: filter context, the rental fact in its shapes,
global order statistics without a single-partition sort."""
