"""Training-data operators: one module per operator, the registered queries in ``queries.py``."""
