"""Training-data operators: one module per operator, ``queries`` for the catalogue entries.

Nothing else in the library imports this sub-package.
"""
