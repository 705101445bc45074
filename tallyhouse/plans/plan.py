"""Query plans: frozen dataclasses, checked when made."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from typing import Any

from .registry import AGGREGATES, BETWEEN, IN, INTENTS, MISSING, NOT_IN, NOT_MISSING, OPERATORS


class PlanError(ValueError):
    """A plan that breaks the contract; it is never executed."""


def need(ok: bool, what: str) -> None:
    if not ok:
        raise PlanError(what)


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None

    def __post_init__(self):
        need(self.operator in OPERATORS, f"unknown operator {self.operator}")
        v = self.value
        if self.operator in (MISSING, NOT_MISSING):
            need(v is None, "a missing test takes no value")
        elif self.operator in (IN, NOT_IN):
            need(isinstance(v, (list, tuple)) and 1 <= len(v) <= 50, "a list of 1 to 50 values is needed")
        elif self.operator == BETWEEN:
            need(isinstance(v, (list, tuple)) and len(v) == 2, "two bounds are needed")
        else:
            need(v is not None and not isinstance(v, (list, tuple)), "one value is needed")


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Aggregation:
    function: str
    field: str | None = None
    group_by: tuple[str, ...] = ()

    def __post_init__(self):
        need(self.function in AGGREGATES, f"unknown aggregate {self.function}")
        need((self.field is None) == (self.function == "count"), "count takes no field, the others need one")
        need(len(self.group_by) <= 2 and len(set(self.group_by)) == len(self.group_by), "at most two different group fields")


@dataclass(frozen=True)
class QueryPlan:
    intent: str
    product_types: tuple[str, ...]
    as_of: date
    filters: tuple[Filter, ...] = ()
    metrics: tuple[str, ...] = ()
    metric_targets: tuple[tuple[str, tuple[str, ...]], ...] = ()
    sort: tuple[Sort, ...] = ()
    aggregation: Aggregation | None = None
    top_k: int = 5
    top_k_scope: str = "global"
    ids: tuple[str, ...] = ()
    constituent: tuple[str, str] | None = None
    #: what a row of the answer is: the product types' own grain, or "product" over several; empty: not stated
    grain: str = ""

    def __post_init__(self):
        need(self.intent in INTENTS, f"unknown intent {self.intent}")
        need(1 <= self.top_k <= 50, "top_k is 1 to 50")
        need(self.top_k_scope in ("global", "per_product_type"), "unknown top_k scope")
        need(len(self.product_types) <= 6 and len(set(self.product_types)) == len(self.product_types), "up to six different product types")
        need(len(self.filters) <= 20 and len(self.metrics) <= 20 and len(self.sort) <= 5, "too many clauses")
        need(len(set(self.metrics)) == len(self.metrics), "repeated metric")
        if self.intent in ("clarify", "unsupported"):
            return
        need(bool(self.product_types), "a product type is needed")
        need((self.aggregation is not None) == (self.intent == "aggregate"), "an aggregation goes with the aggregate intent")
        need(self.intent != "screen_rank" or bool(self.sort), "a ranking needs a sort")
        if self.metric_targets:
            need(self.intent == "screen_rank" and self.top_k_scope == "per_product_type", "metric targets need a ranking by product type")
            need(tuple(t for t, _ in self.metric_targets) == self.product_types, "metric targets follow the product types")
            for _, ms in self.metric_targets:
                need(0 < len(ms) <= 20 and len(set(ms)) == len(ms), "a target has 1 to 20 different metrics")
            if self.metrics:
                need({m for _, ms in self.metric_targets for m in ms} == set(self.metrics), "metric targets cover the plan's metrics")
                need(all(ms == tuple(m for m in self.metrics if m in ms) for _, ms in self.metric_targets), "target metrics keep the plan's order")

    def metrics_of(self, product_type: str) -> tuple[str, ...]:
        return dict(self.metric_targets).get(product_type, ()) if self.metric_targets else self.metrics
