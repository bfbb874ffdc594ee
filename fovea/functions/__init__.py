"""Column expressions and per-group numeric helpers."""
