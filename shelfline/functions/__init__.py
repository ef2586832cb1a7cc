"""Scalar helpers as native column expressions: dates and labels, exact money."""
