"""Operators for preparing text as training data.

Nothing else in the package imports this folder; ``queries`` holds the registered queries.
"""
