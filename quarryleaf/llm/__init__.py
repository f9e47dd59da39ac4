"""Operators that large training-data pipelines need, one module each.

Nothing else in the library imports this package; ``queries.py`` and
``oracles.py`` hold what the entry file registers.
"""
