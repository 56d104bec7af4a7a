"""Training-data operators: one module for each operator, thin queries in ``queries``."""
