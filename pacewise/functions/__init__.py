"""Column helpers (columns.py) and quality rule registries (rules.py)."""
