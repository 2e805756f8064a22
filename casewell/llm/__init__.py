"""Operators of a training-data pipeline. Nothing else in the library imports this package.

`queries()` and `oracle_sql()` list the registered queries; the operators live in one module
each and can be used on any DataFrame."""

from .registry import oracle_sql, queries  # noqa: F401
