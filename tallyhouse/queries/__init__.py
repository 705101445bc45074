"""Queries over the star-schema test tables, each with the DuckDB SQL that gives the same rows."""

from .base import ORACLE_SQL, QUERIES
from . import aggregates, answers, extras, filters, joins, layers, ordering, parsing, policies, ranking  # noqa: F401  they register themselves

__all__ = ["ORACLE_SQL", "QUERIES"]
