"""Functions of the expression language as columns."""
