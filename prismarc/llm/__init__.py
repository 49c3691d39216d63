"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` hold the queries that ``__spark_entry__`` adds.
"""
