"""Plans checked against a registry and split into one segment for each product type."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal

from .plan import Filter, PlanError, QueryPlan, Sort, need
from .registry import BETWEEN, IN, NOT_IN, Metric, ProductType, Registry

#: Columns that a state policy reads, as field names of the type's table.
STATE_COLUMNS = {"bond": ("issue_date", "maturity_date"), "listed": ("saleable", "suspension_flag", "listing_date", "listing_end_date"), "source_only": ()}


@dataclass(frozen=True)
class Segment:
    """The part of a plan that concerns one product type."""

    product_type: ProductType
    plan: QueryPlan
    filters: tuple[Filter, ...]
    sort: tuple[Sort, ...]
    metrics: tuple[Metric, ...]
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Bundle:
    segments: tuple[Segment, ...]
    limitations: tuple[str, ...]


def _literal(kind: str, value) -> None:
    ok = {
        "string": lambda v: isinstance(v, str),
        "boolean": lambda v: isinstance(v, bool),
        "date": lambda v: isinstance(v, date) and not isinstance(v, datetime) or isinstance(v, str) and _is_date(v),
        "decimal": lambda v: isinstance(v, (int, Decimal)) and not isinstance(v, bool),
        "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
        "rating": lambda v: isinstance(v, str),
    }[kind]
    need(ok(value), f"{value!r} is no {kind}")


def _is_date(text: str) -> bool:
    try:
        date.fromisoformat(text)
    except ValueError:
        return False
    return True


def check(plan: QueryPlan, registry: Registry, as_of: date) -> None:
    """Raise PlanError unless every name, operator, literal and combination of the plan is registered."""
    need(plan.as_of == as_of, "the plan's date is not the snapshot's")
    for t in plan.product_types:
        need(t in registry.product_types, f"unknown product type {t}")
    if plan.grain and plan.product_types:
        native = {registry.product_types[t].grain for t in plan.product_types}
        need(plan.grain == "product" and len(plan.product_types) > 1 or native == {plan.grain}, "the grain is not that of the product types")
    asked = {f.field for f in plan.filters} | {s.field for s in plan.sort} | set(plan.metrics) | {m for _, ms in plan.metric_targets for m in ms}
    if plan.aggregation:
        asked |= set(plan.aggregation.group_by) | ({plan.aggregation.field} - {None})
    for name in asked:
        need(name in registry.fields, f"unknown field {name}")
        need(any(registry.has(name, t) for t in plan.product_types), f"{name} is not registered for these product types")
        need(not set(registry.unvalidated.get(name, ())) & set(plan.product_types), f"{name} is not validated for these product types")
    for f in plan.filters:
        field = registry.fields[f.field]
        need(f.operator in field.operators, f"{f.operator} is not registered for {f.field}")
        for t in plan.product_types:
            if registry.has(f.field, t):
                metric = registry.metric_of(f.field, t)
                kind = metric.kind if metric else field.kind
                for v in f.value if f.operator in (IN, NOT_IN, BETWEEN) else () if f.value is None else (f.value,):
                    _literal(kind, v)
                    need(kind != "rating" or v in registry.ratings, f"unknown rating {v!r}")
    for s in plan.sort:
        need(registry.fields[s.field].sortable, f"{s.field} is not sortable")
    if plan.aggregation and plan.aggregation.field:
        need(plan.aggregation.function in registry.fields[plan.aggregation.field].aggregates, f"{plan.aggregation.function} is not registered for {plan.aggregation.field}")
    need(sum(f.field == "holding_constituent" for f in plan.filters) <= 1, "one holding filter at most")
    if any(f.field == "holding_constituent" for f in plan.filters):
        need(plan.constituent is not None, "the constituent is not uniquely resolved")


def split(plan: QueryPlan, registry: Registry) -> Bundle:
    """One segment a product type, in the registry's order, with the clauses that the type registers."""
    limitations: list[str] = []
    asked = {f.field for f in plan.filters} | set(plan.metrics) | {s.field for s in plan.sort} | ({plan.aggregation.field} - {None} if plan.aggregation else set())
    pruned: set[str] = set()
    for name, types, limitation in registry.prunes:
        if name in asked and not plan.metric_targets and set(types) & set(plan.product_types):
            pruned |= set(types)
            limitations.append(limitation)
    out = []
    for name, t in registry.product_types.items():
        if name not in plan.product_types or name in pruned:
            continue
        def own(f, name=name):
            return registry.has(f, name)

        filters = tuple(_canonical(f, t) for f in plan.filters if own(f.field))
        sort = tuple(s for s in plan.sort if own(s.field))
        metric_fields = [m for m in plan.metrics_of(name) if own(m)]
        metric_fields += [s.field for s in sort if registry.fields[s.field].kind == "metric"]
        agg = plan.aggregation
        group = tuple(g for g in agg.group_by if own(g)) if agg else ()
        if agg and agg.field and own(agg.field):
            metric_fields.append(agg.field)
        if agg and agg.field and not own(agg.field):
            raise PlanError(f"{agg.field} is not registered for {name}")
        metrics = tuple(dict.fromkeys(registry.metric_of(m, name) for m in metric_fields))
        fields = list(dict.fromkeys(["product_id", *(f.field for f in filters if f.field != "holding_constituent"), *(m.field for m in metrics), *(s.field for s in sort), *group]))
        if set(registry.currency_with) & set(fields):
            fields.append("currency")
        fields = list(dict.fromkeys([*fields, *STATE_COLUMNS[t.state]]))
        if plan.ids:
            filters = (*filters, Filter("product_id", IN, tuple(plan.ids)))
        out.append(Segment(t, plan, filters, sort, metrics, tuple(fields)))
    need(bool(out), "no product type is left")
    return Bundle(tuple(out), tuple(limitations))


def _canonical(f: Filter, t: ProductType) -> Filter:
    """The filter with literals as the type's table spells them."""
    if isinstance(f.value, str):
        return replace(f, value=t.literals.get((f.field, f.value), f.value))
    return f
