"""Plans executed: check, split, flag, then rank, select or aggregate, all lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import evidence, policy
from .plans.plan import PlanError, QueryPlan
from .plans.registry import Registry
from .plans.segments import Bundle, Segment, check, split


#: Candidates of one segment that a traced plan may have.
CANDIDATES = 100_000


@dataclass(frozen=True)
class Answer:
    """What a plan gives; each part is a lazy DataFrame, or None where its intent has no such part.

    rows: selected products; ranks: competition ranks by partition; aggregates:
    values with counts; counts: exclusions by segment; source: matched rows
    before the state policy; comparison: the difference of a comparing plan's
    two values.
    """

    bundle: Bundle
    rows: DataFrame | None = None
    ranks: DataFrame | None = None
    aggregates: DataFrame | None = None
    counts: DataFrame | None = None
    source: DataFrame | None = None
    comparison: DataFrame | None = None


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class Engine:
    """Answers plans over a registry and its tables (a function from a table's name to a DataFrame)."""

    def __init__(self, registry: Registry, tables: Callable[[str], DataFrame], as_of):
        self.registry, self.tables, self.as_of = registry, tables, as_of

    def frames(self, plan: QueryPlan) -> tuple[Bundle, list[tuple[Segment, DataFrame]]]:
        check(plan, self.registry, self.as_of)
        bundle = split(plan, self.registry)
        return bundle, [(s, policy.flagged(policy.scan(s, self.registry, self.tables), s, self.registry)) for s in bundle.segments]

    def run(self, plan: QueryPlan) -> Answer:
        if plan.intent in ("clarify", "unsupported"):
            return Answer(Bundle((), (f"plan is {plan.intent}",)))
        bundle, frames = self.frames(plan)
        ranking = plan.intent == "screen_rank"
        counts = union([policy.exclusion_counts(df, [policy.valid(m, ranking) for m in s.metrics]).withColumn("product_type", F.lit(s.product_type.name)) for s, df in frames])
        # counts read all rows; every other part reads the matching ones only
        frames_all, frames = frames, [(s, policy.matching(df, s, self.registry)) for s, df in frames]
        source = union([df for _, df in frames])
        if plan.intent == "aggregate":
            return Answer(bundle, aggregates=self.aggregates(plan, frames_all), counts=counts, source=source)
        if plan.intent == "screen_rank" and any(s.metrics for s, _ in frames):
            return Answer(bundle, ranks=self.ranks(plan, frames), counts=counts, source=source)
        compared = self.comparison(plan, frames) if plan.intent == "compare" else None
        return Answer(bundle, rows=self.rows(plan, frames), counts=counts, source=source, comparison=compared)

    def comparison(self, plan: QueryPlan, frames) -> DataFrame | None:
        """Evidence of the difference of two products; None unless the plan has one metric that is a number."""
        if len(plan.metrics) != 1:
            return None
        parts = []
        for s, df in frames:
            m = self.registry.metric_of(plan.metrics[0], s.product_type.name)
            if m and m.kind != "rating":
                parts.append(policy.metric_values(df, s, self.registry, False).where(F.col("metric") == m.name).withColumn("metric", F.lit(m.field)))
        return evidence.comparison(policy.compared_values(union(parts))) if parts else None

    def ranks(self, plan: QueryPlan, frames) -> DataFrame:
        primary = {s.product_type.name: self.registry.metric_of(s.sort[0].field, s.product_type.name) for s, _ in frames if s.sort}
        if any(m and m.needs_period and m.period is None for m in primary.values()):
            raise PlanError("a return needs its period")
        parts = []
        for s, df in frames:
            # globally the plan's direction holds; by product type, that of the segment's own sort
            down = s.sort[0].descending if plan.top_k_scope == "per_product_type" and s.sort else plan.sort[0].descending
            own = policy.metric_values(df, s, self.registry, True)
            parts.append(own.withColumn("sort_position", -F.col("sort_value") if down else F.col("sort_value")))
        values = union(parts).where("valid")
        names = [m.name for m in primary.values() if m]
        values = values.where(F.col("metric").isin(names))
        whole = plan.top_k_scope == "global"
        by = ["partition_key"] if whole else ["partition_key", "product_type"]
        # every partition has its first rows in the result, so that the check of the result is one of all values
        ranked = policy.competition_rank(values, "sort_position", by, False, plan.top_k).drop("sort_position")
        return policy.one_partition(ranked) if whole else ranked

    def rows(self, plan: QueryPlan, frames) -> DataFrame:
        # values are shown as recorded: an invalid one does not drop its row
        included = union([df.where("matched and eligible").drop("matched", "population", "eligible") for _, df in frames])
        order = [(s.field, s.descending) for s in plan.sort if s.field in included.columns]
        return policy.selection(included, order, plan.top_k, None if plan.top_k_scope == "global" else ["product_type"])

    def aggregates(self, plan: QueryPlan, frames) -> DataFrame:
        agg, parts = plan.aggregation, []
        for s, df in frames:
            metric = self.registry.metric_of(agg.field, s.product_type.name) if agg.field else None
            key = policy.partition_key(metric, "currency" in df.columns) if metric else F.lit(f"count:{s.product_type.grain}:{s.product_type.name}")
            ok = policy.valid(metric, False) if metric else None
            by = list(agg.group_by)
            keyed = ["partition_key", *by] if metric or by else []
            # without groups, the rows that the state policy left out count as excluded, in the same pass
            kept = df.where("matched and eligible" if by else "matched").withColumn("partition_key", key)
            out = policy.aggregated(kept, agg.function, agg.field, keyed, ok, F.col("eligible"))
            if not by:
                left_out = F.sum("left_out").over(W.partitionBy()) if metric else F.col("left_out")
                out = out.withColumn("excluded_count", F.col("excluded_count") + left_out)
            if metric:  # a partition is there if it has a comparable value
                all_included = F.sum("included_count").over(W.partitionBy("partition_key")) if by else F.col("included_count")
                out = out.withColumn("all_included", all_included).where("all_included > 0").drop("all_included")
            out = out.drop("left_out")
            if not keyed:
                out = out.withColumn("partition_key", key)
            out = out.withColumn("product_type", F.lit(s.product_type.name))
            if s.sort and s.sort[0].field == agg.field:
                order = [F.col("value").desc_nulls_last() if s.sort[0].descending else F.col("value").asc_nulls_last(), *policy.group_order(by)]
            else:
                order = policy.group_order(by)
            if by:
                out = policy.first_of(out, F.row_number().over(W.partitionBy("product_type", "partition_key").orderBy(*order)), plan.top_k, "position")
            parts.append(out)
        result = union(parts)
        return policy.one_partition(result) if agg.field and plan.top_k_scope == "global" else result

    def result(self, plan: QueryPlan, frames) -> DataFrame:
        """The part of the answer that the intent asks for, of flagged frames."""
        if plan.intent == "aggregate":
            return self.aggregates(plan, frames)
        frames = [(s, df.where("matched")) for s, df in frames]
        if plan.intent == "screen_rank" and any(s.metrics for s, _ in frames):
            return self.ranks(plan, frames)
        return self.rows(plan, frames)

    def traced(self, plan: QueryPlan, path: str | None = None, most: int = CANDIDATES) -> tuple[DataFrame | None, DataFrame]:
        """The result, written to ``path`` in one job that reads each table once, and the trace of that very pass.

        The trace has a row a segment: product_type, grain, all_rows,
        candidates (rows that pass all filters on no metric), excluded_by_filter,
        excluded_by_state, excluded_by_metric, included and returned. More than
        ``most`` candidates of a segment are an error: within a task
        at once, over all tasks when the counts are in. Counts are kept by the
        engine's observations; a stage that runs again after a lost executor
        may add its rows twice, which all_rows shows. Without a path the rows are not kept.
        """
        ranking = plan.intent == "screen_rank"
        _, frames = self.frames(plan)
        seen, watched = [], []
        for s, df in frames:
            seen.append(Observation())
            measures = policy.exclusion_measures([policy.valid(m, ranking) for m in s.metrics])
            df = df.observe(seen[-1], *measures, F.count_if("population").alias("candidates"))
            watched.append((s, policy.limited(df.where("population"), most)))
        last = Observation()
        result = self.result(plan, watched)
        result = result.observe(last, *(F.count_if(F.col("product_type") == s.product_type.name).alias(s.product_type.name) for s, _ in frames))
        write = result.write.mode("errorifexists")
        write.parquet(path) if path else write.format("noop").mode("overwrite").save()
        rows = []
        for (s, _), o in zip(frames, seen):
            x = o.get
            if x["candidates"] > most:
                raise PlanError(policy.TOO_MANY)
            names = ("all_rows", "candidates", "excluded_by_filter", "excluded_by_state", "excluded_by_metric", "included")
            rows.append((s.product_type.name, s.product_type.grain, *(x.get(n, 0) for n in names), last.get[s.product_type.name]))
        spark = result.sparkSession
        trace = spark.createDataFrame(rows, "product_type string, grain string, all_rows long, candidates long, excluded_by_filter long, excluded_by_state long, excluded_by_metric long, included long, returned long")
        return spark.read.schema(result.schema).parquet(path) if path else None, trace
