"""Documents out of rows."""
