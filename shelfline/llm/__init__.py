"""Operators for large training-data tables and their registered queries.

Nothing else in the library imports this subpackage.
"""
