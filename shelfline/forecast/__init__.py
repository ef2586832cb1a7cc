"""Panel forecasting (F1-F28): many monthly series at once, distributed by series."""
