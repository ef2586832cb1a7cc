"""Registered queries: every mart with the parameters used for the oracle check.

Importing this package registers all entries in :mod:`shelfline.registry`.
"""

from . import extra, forecasting, io, marts, overview, reports, text  # noqa: F401
