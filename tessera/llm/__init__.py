"""Training-data operators: one module each, queries in ``queries.py``."""
