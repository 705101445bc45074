"""Filters as Columns. A null never passes, in either direction, but for the tests of missing values."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Filter
from ..plans.registry import BETWEEN, CONTAINS, EQ, GT, GTE, IN, LT, LTE, MISSING, NE, NOT_IN, NOT_MISSING, STARTS

COMPARE = {EQ: Column.__eq__, NE: Column.__ne__, GT: Column.__gt__, GTE: Column.__ge__, LT: Column.__lt__, LTE: Column.__le__}


def literal(value, kind: str) -> Column:
    """A literal in the type of its column."""
    if kind == "date":
        return F.lit(value if isinstance(value, date) else date.fromisoformat(value))
    if kind == "decimal":
        return F.lit(str(Decimal(value))).cast("decimal(38,18)")
    return F.lit(value)


def ordinal(rating: Column, ratings: dict[str, int]) -> Column:
    """A rating's strength (smaller is stronger); null for what is not rated."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ratings.items() for x in kv)), rating)


def test(f: Filter, column: Column, kind: str, ratings: dict[str, int] | None = None) -> Column:
    """True or false, never null: a flag that can be counted."""
    return F.coalesce(condition(f, column, kind, ratings), F.lit(False))


def condition(f: Filter, column: Column, kind: str, ratings: dict[str, int] | None = None) -> Column:
    """The bare condition, null on nulls: as a filter it says the same as the flag, and the scan can take it."""
    op, v = f.operator, f.value
    if op == MISSING:
        return column.isNull()
    if op == NOT_MISSING:
        return column.isNotNull()
    if kind == "rating" and op in (GT, GTE, LT, LTE):  # at least as strong is a smaller ordinal
        mirror = {GTE: LTE, LTE: GTE, GT: LT, LT: GT}[op]
        return COMPARE[mirror](ordinal(column, ratings), F.lit(ratings[v]))
    if op in (IN, NOT_IN):
        ok = column.isin([literal(x, kind) for x in v])
        return ~ok if op == NOT_IN else ok
    if op == BETWEEN:
        return column.between(literal(v[0], kind), literal(v[1], kind))
    if op == CONTAINS:
        return column.contains(F.lit(v))
    if op == STARTS:
        return column.startswith(F.lit(v))
    return COMPARE[op](column, literal(v, kind))


def semi_exists(owners: DataFrame, relation: DataFrame, on: Column) -> DataFrame:
    """Owners with at least one related row, as a left semi join."""
    return owners.join(relation, on, "left_semi")
