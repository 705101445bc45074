"""What an answer has to say of its own limits: a rule table over the counts of the answer's parts.

Facts come as tall rows (fact, number) from the parts that a plan gives; one
aggregation turns them into one row, and each rule is a condition and a detail over it. An
aggregate that left rows out has a limitation of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import Answer
from ..plans.plan import QueryPlan
from ..plans.registry import MISSING, NOT_MISSING, Registry

#: Facts that rules read; those that no part gives are 0.
FACTS = ("excluded_by_state", "excluded_by_metric", "included", "currencies", "over_cut", "recorded", "comparable", "missing", "recorded_zeros", "warned")


def tall(df: DataFrame, **facts: Column) -> DataFrame:
    """One aggregation of ``df`` as rows (fact, number)."""
    return df.agg(*(F.coalesce(c.cast("long"), F.lit(0)).alias(k) for k, c in facts.items())).select(F.inline(F.array(*(F.struct(F.lit(k).alias("fact"), F.col(k).alias("number")) for k in facts))))


def facts_of(plan: QueryPlan, answer: Answer, lens: DataFrame | None = None, population: DataFrame | None = None, zeros: DataFrame | None = None) -> list[DataFrame]:
    """Facts of an answer's parts; lens: ``policy.dual_lens``, population: ``policy.population_counts``, zeros: ``evidence.recorded_zeros``."""
    out = []
    if answer.counts is not None:
        metric = F.sum("excluded_by_metric") if "excluded_by_metric" in answer.counts.columns else F.lit(0)
        out.append(tall(answer.counts, excluded_by_state=F.sum("excluded_by_state"), excluded_by_metric=metric, included=F.sum("included")))
    for part in (answer.ranks, answer.aggregates):
        if part is not None and "partition_key" in part.columns:
            currency = F.split("partition_key", ":")[1]
            out.append(tall(part, currencies=F.count_distinct(F.when(currency != "None", currency))))
    if answer.ranks is not None:
        by = ["partition_key"] if plan.top_k_scope == "global" else ["partition_key", "product_type"]
        out.append(tall(answer.ranks.groupBy(*by).count(), over_cut=F.count_if(F.col("count") > plan.top_k)))
    if answer.rows is not None and "warnings" in answer.rows.columns:
        out.append(tall(answer.rows, warned=F.count_if(F.size("warnings") > 0)))
    if lens is not None:
        out.append(tall(lens, recorded=F.sum("recorded"), comparable=F.sum("comparable")))
    if population is not None:
        out.append(tall(population, missing=F.sum("missing")))
    if zeros is not None:
        out.append(tall(zeros, recorded_zeros=F.count(F.lit(1))))
    return out


def rules(plan: QueryPlan, registry: Registry) -> list[tuple[str, Column, Column]]:
    """(limitation, when it holds, detail) in the order in which an answer says them."""
    f, always, never = F.col, F.lit(True), F.lit(False)
    metrics = [m for t in plan.product_types for x in plan.filters if (m := registry.metric_of(x.field, t))]
    rated = any(m.kind == "rating" for m in metrics)
    asks_missing = any(x.operator in (MISSING, NOT_MISSING) for x in plan.filters)
    return [
        ("snapshot", always, F.lit(plan.as_of.isoformat())),
        ("recorded_and_comparable_differ", f("recorded") != f("comparable"), F.format_string("%d of %d recorded values are comparable", f("comparable"), f("recorded"))),
        ("rating_order", always if rated else never, F.lit("unrated values are left out")),
        ("comparison_incomplete", (f("excluded_by_state") > 0) & (f("included") < 2) if plan.intent == "compare" else never, F.format_string("%d of two products", f("included"))),
        ("missing_values", always if asks_missing else (f("missing") > 0) if plan.intent == "screen_rank" else never, F.format_string("%d values are missing", f("missing"))),
        ("ties_across_the_cut", f("over_cut") > 0, F.format_string("in %d partitions", f("over_cut"))),
        ("several_currencies", f("currencies") > 1, F.format_string("%d currencies are not compared", f("currencies"))),
        ("recorded_zeros", f("recorded_zeros") > 0, F.format_string("%d recorded zeros are not compared", f("recorded_zeros"))),
        ("state_not_verified", f("warned") > 0, F.format_string("of %d products", f("warned"))),
    ]


def limitations(plan: QueryPlan, answer: Answer, registry: Registry, **parts: DataFrame | None) -> DataFrame:
    """limitation and detail of an answer, without repeats; the parts are those of ``facts_of``."""
    found = facts_of(plan, answer, **parts)
    spark = next(x for x in (answer.counts, answer.rows, answer.ranks, answer.aggregates) if x is not None).sparkSession
    facts = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "fact string, number long")
    row = facts.agg(*(F.coalesce(F.sum(F.when(F.col("fact") == k, F.col("number"))), F.lit(0)).alias(k) for k in FACTS))
    table = F.array(*(F.struct(F.lit(n).alias("limitation"), F.coalesce(ok, F.lit(False)).alias("holds"), detail.alias("detail")) for n, ok, detail in rules(plan, registry)))
    out = row.select(F.inline(table)).where("holds").select("limitation", "detail")
    if answer.aggregates is not None:
        partial = answer.aggregates.where("excluded_count > 0").select(F.lit("aggregate_is_partial").alias("limitation"), F.format_string("%d included, %d left out", "included_count", "excluded_count").alias("detail"))
        out = out.unionByName(partial.distinct())
    return out
