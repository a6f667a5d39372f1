"""Operators for preparing language-model training data.

Nothing else in the library imports this package; ``catalog`` lists its
queries and their SQL for ``__spark_entry__``.
"""
