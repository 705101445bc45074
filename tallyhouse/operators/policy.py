"""The policy steps over a segment's rows, as flags that keep every row countable.

Rows are flagged in this order and never dropped before they are counted:
``matched`` (all filters), ``population`` (filters on no metric), ``eligible``
(state at the as-of date), then by metric ``valid``. Rankings, selections and
aggregates read the flags.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import COMPARABLE, Metric, Registry
from ..plans.segments import Segment
from .predicates import condition, ordinal, test


#: What a result that breaks its contract fails with.
TOO_MANY, NOT_ONE = "candidate limit exceeded", "a global result needs one comparable partition"


def status(name: str) -> str:
    return f"{name}__status"


def eligible(state: str, as_of: date) -> Column:
    """Whether a product can be had at the date, by its type's state policy."""
    day = F.lit(as_of)
    if state == "listed":
        open_end = F.col("listing_end_date").isNull() & F.col(status("listing_end_date")).isin("missing_blank", "sentinel_max_date")
        parts = [F.col("saleable"), ~F.coalesce(F.col("suspension_flag"), F.lit(False)), F.col("listing_date") <= day, F.coalesce(F.col("listing_end_date") >= day, F.lit(False)) | open_end]
        ok = F.lit(True)
        for p in parts:
            ok = ok & F.coalesce(p, F.lit(False))
        return ok
    if state == "bond":
        return ~F.coalesce(F.col("issue_date") > day, F.lit(False)) & ~F.coalesce(F.col("maturity_date") < day, F.lit(False))
    return F.lit(True)


def warnings(state: str) -> Column:
    if state == "bond":
        return F.when(F.col("maturity_date").isNull(), F.array(F.lit("bond end state is not source-verifiable"))).otherwise(F.array().cast("array<string>"))
    return F.array(F.lit("source state only")) if state == "source_only" else F.array().cast("array<string>")


def scan(segment: Segment, registry: Registry, tables) -> DataFrame:
    """The segment's columns under field names, each with its quality status. tables: name to DataFrame."""
    t = segment.product_type
    df = tables(t.table)
    if t.discriminator:
        df = df.where(F.col(t.discriminator[0]) == F.lit(t.discriminator[1]))
    columns = [F.lit(t.name).alias("product_type")]
    for f in segment.fields:
        source = t.column(f)
        quality = f"{source}__quality_status"
        columns += [F.col(source).alias(f), (F.col(quality) if quality in df.columns else F.when(F.col(source).isNull(), F.lit("missing_blank")).otherwise(F.lit("valid"))).alias(status(f))]
    if segment.plan.constituent and any(f.field == "holding_constituent" for f in segment.filters):
        kind, value = segment.plan.constituent
        held = tables("silver_product_holding").where((F.col("constituent_identifier_type") == F.lit(kind)) & (F.col("constituent_identifier") == F.lit(value)))
        df = df.join(held.select("owner_product_type", "owner_product_id"), (F.col("owner_product_id") == F.col(t.id_column)) & (F.col("owner_product_type") == F.lit(t.name)), "left_semi")
    return df.select(*columns)


def flagged(df: DataFrame, segment: Segment, registry: Registry) -> DataFrame:
    """``df`` with matched, population and eligible."""
    matched, population = F.lit(True), F.lit(True)
    for f in segment.filters:
        if f.field == "holding_constituent":
            continue
        metric = registry.metric_of(f.field, segment.product_type.name)
        ok = test(f, F.col(f.field), metric.kind if metric else registry.fields[f.field].kind, registry.ratings)
        matched = matched & ok
        population = population if metric else population & ok
    return df.withColumns({"matched": matched, "population": population, "eligible": eligible(segment.product_type.state, segment.plan.as_of)})


def matching(df: DataFrame, segment: Segment, registry: Registry) -> DataFrame:
    """Rows that match all filters, by bare conditions that reach the scan; for parts that count no excluded rows."""
    for f in segment.filters:
        if f.field != "holding_constituent":
            metric = registry.metric_of(f.field, segment.product_type.name)
            df = df.where(condition(f, F.col(f.field), metric.kind if metric else registry.fields[f.field].kind, registry.ratings))
    return df


def valid(metric: Metric, ranking: bool) -> Column:
    """Whether a metric's value may be compared; only zeros fall to a policy of positive values."""
    ok = F.col(status(metric.field)).isin(*COMPARABLE) & F.col(metric.field).isNotNull()
    if metric.kind == "rating":
        return ok
    zero = F.col(metric.field) == 0
    if metric.zero_policy == "unverified" or ranking and "positive" in metric.ranking_policy:
        ok = ok & ~F.coalesce(zero, F.lit(False))
    return ok


def partition_key(metric: Metric, has_currency: bool) -> Column:
    """group:currency:period:policy; values are compared only within one key. No currency column, no currency."""
    currency = F.coalesce(F.col("currency"), F.lit("None")) if has_currency else F.lit("None")
    return F.concat_ws(":", F.lit(metric.group), currency, F.lit(metric.period or "None"), F.lit("positive" if "positive" in metric.ranking_policy else "any"))


def metric_values(df: DataFrame, segment: Segment, registry: Registry, ranking: bool) -> DataFrame:
    """Tall: product_type, product_id, metric, value, sort_value, status, valid, partition_key of included rows."""
    out = None
    for m in segment.metrics:
        sort_value = -ordinal(F.col(m.field), registry.ratings).cast("decimal(38,18)") if m.kind == "rating" else F.col(m.field).cast("decimal(38,18)")
        part = df.where("matched and eligible").select(
            "product_type", "product_id", F.lit(m.name).alias("metric"), F.col(m.field).cast("string").alias("value"), sort_value.alias("sort_value"),
            F.col(status(m.field)).alias("status"), (valid(m, ranking) & sort_value.isNotNull()).alias("valid"), partition_key(m, "currency" in df.columns).alias("partition_key"))
        out = part if out is None else out.unionByName(part)
    return out


def first_of(df: DataFrame, number: Column, most: int, name: str) -> DataFrame:
    """Rows whose window number is at most ``most``, as a bigint column.

    The filter stands on the bare window function: only then does the engine
    put a group limit before the shuffle.
    """
    return df.withColumn(name, number).where(F.col(name) <= most).withColumn(name, F.col(name).cast("bigint"))


def competition_rank(df: DataFrame, value: str, by: list[str], descending: bool, top_k: int, tie_break: str = "product_id") -> DataFrame:
    """Ranks 1, 1, 3 within ``by`` up to top_k, whole tie groups kept, with the size of each tie group.

    The cut comes before the tie count: tie groups are intact after it, and the
    engine can then limit each group's rows before the shuffle.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ranked = first_of(df, F.rank().over(W.partitionBy(*by).orderBy(order)), top_k, "rank")
    return ranked.withColumn("tie_count", F.count(F.lit(1)).over(W.partitionBy(*by, "rank")))


def evidence_rows(ranked: DataFrame, by: list[str], cap: int, tie_break: str = "product_id") -> DataFrame:
    """The first ``cap`` ranked rows of each partition, ties by id."""
    return first_of(ranked, F.row_number().over(W.partitionBy(*by).orderBy("rank", tie_break)), cap, "position")


def selection(df: DataFrame, order: list[tuple[str, bool]], top_k: int, per: list[str] | None = None, tie_break: str = "product_id") -> DataFrame:
    """The first rows by several keys, nulls last in both directions, then by id; over all rows or per group."""
    keys = [(F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last()) for c, d in order] + [F.col(tie_break).asc()]
    if not per:
        return df.orderBy(*keys).limit(top_k)
    return first_of(df, F.row_number().over(W.partitionBy(*per).orderBy(*keys)), top_k, "position")


def exact_average(number: Column) -> Column:
    """The average of a decimal(38,18), rounded once, half to even, at 18 digits; below 10^16, as the engine's own average.

    The engine's average has 22 digits. Rounding that again errs only where its
    last four digits look like a half; there the sum's remainder by the count,
    in units of the last digit, says on which side of the half it is.
    """
    mean, last = F.avg(number), F.lit(Decimal("1E-18"))
    part = F.count(number).cast("decimal(18,0)") * last
    remainder = F.abs(F.sum(number)) % part
    half = (F.abs(mean) % last) == F.lit(Decimal("5E-19"))
    # towards zero and one digit away from it; only used where the mean looks like a half
    inner = F.when(half, mean - F.signum(mean.cast("double")).cast("decimal(1,0)") * F.lit(Decimal("5E-19")))
    outer = inner + F.signum(mean.cast("double")).cast("decimal(1,0)") * last
    twice = remainder + remainder
    return F.when(half & (twice < part), inner).when(half & (twice > part), outer).otherwise(F.bround(mean, 18)).cast("decimal(38,18)")


def aggregated(df: DataFrame, function: str, field: str | None, by: list[str], ok: Column | None = None, among: Column | None = None) -> DataFrame:
    """value, included_count and excluded_count by group; one row where nothing is grouped.

    among: the rows that are aggregated, where not all are; left_out then
    counts the others in the same pass. avg is exact to 18 digits, half to even
    (``exact_average``); the sums are exact decimals.
    """
    others = [] if among is None else [F.count_if(~F.coalesce(among, F.lit(False))).alias("left_out")]
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    number = F.when(among & (ok if ok is not None else F.lit(True)), F.col(field)) if field else None
    if function == "count":
        value = F.count_if(among).cast("decimal(38,18)")
    elif function == "avg":
        value = exact_average(number.cast("decimal(38,18)"))
    else:
        value = getattr(F, function)(number.cast("decimal(38,18)")).cast("decimal(38,18)")
    included = F.count_if(among) if number is None else F.count(number)
    return df.groupBy(*by).agg(value.alias("value"), included.alias("included_count"), (F.count_if(among) - included).alias("excluded_count"), *others)


def group_order(by: list[str]) -> list[Column]:
    """Groups by the text of their keys, null as None."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("None")).asc() for c in by]


def exclusion_measures(valid_metrics: list[Column] = ()) -> list[Column]:
    """Counts over flagged rows: all_rows, excluded_by_filter, excluded_by_state, included; with metrics' conditions also excluded_by_metric, the included rows' values that may not be compared."""
    included = F.col("matched") & F.col("eligible")
    values = [sum((F.count_if(included & ~F.coalesce(ok, F.lit(False))) for ok in valid_metrics), F.lit(0).cast("bigint")).alias("excluded_by_metric")] if valid_metrics else []
    return [
        *values, F.count(F.lit(1)).alias("all_rows"), F.count_if(~F.col("matched")).alias("excluded_by_filter"),
        F.count_if(F.col("matched") & ~F.col("eligible")).alias("excluded_by_state"), F.count_if(included).alias("included")]


def exclusion_counts(df: DataFrame, valid_metrics: list[Column] = ()) -> DataFrame:
    """One row of ``exclusion_measures``."""
    return df.agg(*exclusion_measures(valid_metrics))


def limited(df: DataFrame, most: int) -> DataFrame:
    """``df``, whose task fails as soon as it alone has more than ``most`` rows; the sum over all tasks is for ``observe``."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return df.where(F.when(place < most, F.lit(True)).otherwise(F.raise_error(F.lit(TOO_MANY)).cast("boolean")))


def one_partition(df: DataFrame) -> DataFrame:
    """``df``, which fails when it runs if it has several partition keys; for a result of one key, whose rows are one task's anyway."""
    w = W.partitionBy()
    one = F.min("partition_key").over(w) == F.max("partition_key").over(w)
    checked = df.withColumn("_one", F.when(one, F.lit(True)).otherwise(F.raise_error(F.lit(NOT_ONE)).cast("boolean")))
    return checked.where("_one").drop("_one")


def population_counts(df: DataFrame, field: str, ok: Column) -> DataFrame:
    """One row on the eligible population before metric filters: comparable, missing and zero values."""
    base = F.col("population") & F.col("eligible")
    return df.agg(
        F.count_if(base & ok).alias("comparable"), F.count_if(base & F.col(field).isNull()).alias("missing"),
        F.count_if(base & F.coalesce(F.col(field) == 0, F.lit(False))).alias("zero"), F.count_if(base).alias("population_rows"))


def dual_lens(df: DataFrame, field: str, ok: Column, by: list[str]) -> DataFrame:
    """Recorded and comparable values by group, and whether the two views differ."""
    return df.groupBy(*by).agg(F.count(field).alias("recorded"), F.count_if(ok).alias("comparable")).withColumn("differs", F.col("recorded") != F.col("comparable"))


def records_by_id(df: DataFrame, id_column: str, ids: list[str], most: int = 50) -> DataFrame:
    """The records of a plan's ids, exactly one each; any other number is an error."""
    wanted = sorted(set(ids))
    if not 1 <= len(wanted) <= most or len(wanted) != len(ids):
        raise ValueError(f"1 to {most} different ids are needed")
    found = df.where(F.col(id_column).isin(wanted))
    n = found.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(id_column).alias("n_ids")).first()
    if (n["n_rows"], n["n_ids"]) != (len(wanted), len(wanted)):
        raise ValueError(f"{n['n_rows']} records of {n['n_ids']} ids, not one of each of {len(wanted)}")
    return found


def compared_pairs(df: DataFrame, left_id, right_id, value: str, id_column: str = "product_id") -> DataFrame:
    """Two products side by side: values, absolute difference and direction; ids that are not there once each are an error."""
    found = records_by_id(df, id_column, [left_id, right_id])
    a = found.where(F.col(id_column) == F.lit(left_id)).select(F.col(id_column).alias("left_id"), F.col(value).alias("left_value"))
    b = found.where(F.col(id_column) == F.lit(right_id)).select(F.col(id_column).alias("right_id"), F.col(value).alias("right_value"))
    sign = F.signum((F.col("left_value") - F.col("right_value")).cast("double"))
    return a.join(b, F.lit(True)).withColumns({"difference": F.abs(F.col("left_value") - F.col("right_value")), "direction": F.when(sign > 0, "higher").when(sign < 0, "lower").when(sign == 0, "equal")})


def compared_values(values: DataFrame) -> DataFrame:
    """The difference of exactly two comparable values of one product type, of a tall table (``metric_values``); else no row.

    product_id is the product with the larger value, the first by id at a tie;
    low_id and high_id are both in the order of ids. One aggregation of
    constant size, whatever the number of rows.
    """
    end = F.struct("product_type", "product_id", "metric", "sort_value")
    both = values.where("valid").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("a"), F.max(end).alias("b"))
    both = both.where("n = 2 and a.product_type = b.product_type and a.product_id <> b.product_id and a.metric = b.metric")
    return both.select(
        "a.product_type", F.when(F.col("b.sort_value") > F.col("a.sort_value"), F.col("b.product_id")).otherwise(F.col("a.product_id")).alias("product_id"), "a.metric",
        F.col("a.product_id").alias("low_id"), F.col("b.product_id").alias("high_id"), F.abs(F.col("b.sort_value") - F.col("a.sort_value")).alias("difference"))


def reversed_selection(df: DataFrame, value: str, descending: bool, top_k: int, by: list[str], tie_break: str = "product_id") -> DataFrame:
    """The first rows of each partition by (value, id) as one key: a descending order turns the ids round too."""
    order = [F.col(value).desc(), F.col(tie_break).desc()] if descending else [F.col(value).asc(), F.col(tie_break).asc()]
    w = W.partitionBy(*by).orderBy(*order)
    return first_of(df.where(F.col(value).isNotNull()), F.row_number().over(w), top_k, "position")


def shown_values(values: DataFrame, selected: DataFrame) -> DataFrame:
    """Tall metric values of the selected rows only."""
    return values.join(selected.select("product_type", "product_id").distinct(), ["product_type", "product_id"], "left_semi")


def source_average(df: DataFrame, field: str, by: list[str], places: int = 22) -> DataFrame:
    """Average over all recorded values, not rounded to the stored scale."""
    return df.groupBy(*by).agg((F.avg(F.col(field).cast("decimal(38,18)"))).cast(f"decimal(38,{places})").alias("source_average"), F.count(field).alias("recorded"))


def source_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Matched rows before and after the state policy, and their difference."""
    out = df.groupBy(*by).agg(F.count_if("matched").alias("source"), F.count_if(F.col("matched") & F.col("eligible")).alias("validated"))
    return out.withColumn("difference", F.col("source") - F.col("validated"))
