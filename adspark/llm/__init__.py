"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; each ``opN_*`` module holds one
operator, and ``queries`` registers the driver-facing queries.
"""
