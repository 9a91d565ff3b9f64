"""Operators for preparing training text: one module for each operator.

Nothing outside this subpackage imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list what the repository's entry file adds.
"""
