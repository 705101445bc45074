"""Aggregates with counts, collapse of lots, roll-ups, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collapse, policy, quality
from ..plans.plan import Aggregation, Filter, QueryPlan, Sort
from .base import AS_OF, REGISTRY, engine, query, silver, silver_sql, table

GOOD = "balance__quality_status in ('valid', 'recorded_zero', 'constant_metric') and balance is not null"
STATE = "issue_date <= date '1998-01-01' and (maturity_date is null or maturity_date >= date '1998-01-01')"


def aggregate(kind, aggregation, *names, filters=(), sort=()):
    def run(spark, sf_dir):
        plan = QueryPlan("aggregate", (kind,), AS_OF, filters=filters, aggregation=aggregation, sort=sort, top_k=50, top_k_scope="per_product_type")
        out = engine(spark, sf_dir).run(plan).aggregates
        return out.select(*(F.col(n).cast("double").alias(n) if n == "value" else F.col(n) for n in names))

    return run


query("agg_count", f"select 'count:order:order' as partition_key, cast(count(*) filter ({STATE}) as double) as value, count(*) filter ({STATE}) as included_count, count(*) filter (not ({STATE})) as excluded_count from {silver_sql('orders')}")(
    aggregate("order", Aggregation("count"), "partition_key", "value", "included_count", "excluded_count"))
for f in ("min", "max", "sum"):
    query(f"agg_{f}", f"""select 'balance:' || currency || ':snapshot:positive' as partition_key, cast({f}(balance) filter ({GOOD}) as double) as value, count(*) filter ({GOOD}) as included_count, count(*) filter (not ({GOOD})) as excluded_count
        from {silver_sql('customer')} group by currency""")(aggregate("customer", Aggregation(f, "balance"), "partition_key", "value", "included_count", "excluded_count"))
query("agg_avg", f"""select 'balance:' || currency || ':snapshot:positive' as partition_key, round(cast(sum(balance) filter ({GOOD}) as double) / count(*) filter ({GOOD}), 6) as value
    from {silver_sql('customer')} group by currency""")(lambda spark, sf_dir: aggregate("customer", Aggregation("avg", "balance"), "partition_key", "value")(spark, sf_dir).withColumn("value", F.round("value", 6)))

@query("agg_group2", f"select currency, region, cast(sum(balance) filter ({GOOD}) as double) as value, count(*) filter ({GOOD}) as included_count, count(*) filter (not ({GOOD})) as excluded_count from {silver_sql('customer')} group by 1, 2")
def agg_group2(spark, sf_dir):
    df = silver(spark, sf_dir, "customer").withColumnRenamed("balance__quality_status", policy.status("balance"))
    ok = policy.valid(REGISTRY.metrics["account.balance"], False)
    return policy.aggregated(df, "sum", "balance", ["currency", "region"], ok).withColumn("value", F.col("value").cast("double"))


query("agg_partition", f"""select partition_key, region, value, "position" from (select 'balance:' || currency || ':snapshot:positive' as partition_key, region, cast(min(balance) filter ({GOOD}) as double) as value,
    row_number() over (partition by currency order by coalesce(region, 'None')) as "position" from {silver_sql('customer')} group by currency, region) where "position" <= 50""")(
    aggregate("customer", Aggregation("min", "balance", ("region",)), "partition_key", "region", "value", "position"))
query("agg_topk", f"""select currency, value from (select currency, cast(max(price) as double) as value, row_number() over (order by max(price) desc nulls last, currency) as n from {silver_sql('part')} group by currency) where n <= 50""")(
    aggregate("part", Aggregation("max", "price", ("currency",)), "currency", "value", sort=(Sort("price", True),)))


@query("agg_counts", f"""select product_type, all_rows, excluded_by_filter, excluded_by_state, included from (select 'order' as product_type, count(*) as all_rows, count(*) filter (not total > 100000) as excluded_by_filter,
    count(*) filter (total > 100000 and not ({STATE})) as excluded_by_state, count(*) filter (total > 100000 and {STATE}) as included from {silver_sql('orders')})""")
def agg_counts(spark, sf_dir):
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("total", "gt", 100000),))
    return engine(spark, sf_dir).run(plan).counts.select("product_type", "all_rows", "excluded_by_filter", "excluded_by_state", "included")


LINES = "lineitem"
ORDER = "l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("collapse_argmax", f"""select l_partkey, l_orderkey, l_suppkey, l_linenumber, l_discount, l_extendedprice from (select *, row_number() over (partition by l_partkey order by l_discount desc nulls last, {ORDER}) as n from lineitem) where n = 1""")
def collapse_argmax(spark, sf_dir):
    out = collapse.best_row(table(spark, sf_dir, LINES), ["l_partkey"], "l_discount", [F.col(c).asc() for c in ORDER.split(", ")])
    return out.select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_extendedprice")


@query("collapse_consensus", """select l_orderkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) end as value, case when count(distinct l_returnflag) = 1 then 'valid' else 'mixed_source_values' end as status,
    count(distinct l_returnflag) as n_values from lineitem group by l_orderkey""")
def collapse_consensus(spark, sf_dir):
    return collapse.consensus(table(spark, sf_dir, LINES), ["l_orderkey"], "l_returnflag")


@query("collapse_range", "select l_partkey, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by l_partkey")
def collapse_range(spark, sf_dir):
    return collapse.value_range(table(spark, sf_dir, LINES), ["l_partkey"], "l_extendedprice")


@query("collapse_lineage", "select l_orderkey, array_to_string(list_sort(list(distinct l_partkey || ':' || l_suppkey)), ',') as sources from lineitem group by l_orderkey")
def collapse_lineage(spark, sf_dir):
    df = table(spark, sf_dir, LINES).withColumn("source", F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    out = collapse.lineage(df, ["l_orderkey"], ["source"])
    return out.select("l_orderkey", F.array_join(F.transform("sources", lambda s: s["source"]), ",").alias("sources"))


def raw_issues(spark, sf_dir):
    df = silver(spark, sf_dir, "customer")
    a = quality.issues(df, "customer", ["product_id"], "balance", F.col("balance__quality_status"), "balance_rule", "warning")
    b = quality.issues(silver(spark, sf_dir, "supplier"), "supplier", ["product_id"], "balance", F.col("balance__quality_status"), "balance_rule", "error")
    return a.unionByName(b)


ISSUES = f"""select 'customer' as source, product_id as row_key, 'balance' as column_name, balance__quality_status as status, 'balance_rule' as rule, 'warning' as severity from {silver_sql('customer')} where balance__quality_status not in ('valid', 'recorded_zero', 'constant_metric')
    union all select 'supplier', product_id, 'balance', balance__quality_status, 'balance_rule', 'error' from {silver_sql('supplier')} where balance__quality_status not in ('valid', 'recorded_zero', 'constant_metric')"""


@query("issue_ids", f"select *, sha256(source || chr(0) || row_key || chr(0) || column_name || chr(0) || status || chr(0) || rule) as issue_id from ({ISSUES})")
def issue_ids(spark, sf_dir):
    return raw_issues(spark, sf_dir)


@query("issue_rollup", "with i as (" + ISSUES + ") " + " union all ".join(f"select '{d}' as dimension, {d} as name, count(*) as n_issues, count(distinct source || '|' || row_key) as n_rows from i group by {d}" for d in ("source", "rule", "severity", "status")))
def issue_rollup(spark, sf_dir):
    return quality.rollup(raw_issues(spark, sf_dir))


@query("dup_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def dup_keys(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, LINES), ["l_orderkey", "l_linenumber"])


PROFILED = ("c_name", "c_mktsegment", "c_nationkey")


@query("profile_blank_zero", " union all ".join(f"""select '{c}' as column_name, count(*) filter (trim(coalesce(cast({c} as string), '')) = '') as blank, count(*) filter (trim(coalesce(cast({c} as string), '')) <> '') as nonblank,
    count(*) filter (try_cast(trim(cast({c} as string)) as decimal(38,18)) = 0) as numeric_zero, max(trim(cast({c} as string))) as max_text from customer""" for c in PROFILED))
def profile_blank_zero(spark, sf_dir):
    return quality.profile(table(spark, sf_dir, "customer"), list(PROFILED))


@query("multiplicity", "select times, count(*) as n_keys from (select l_orderkey, count(*) as times from lineitem group by 1 having count(*) > 1) group by times")
def multiplicity(spark, sf_dir):
    return quality.multiplicity(table(spark, sf_dir, LINES), "l_orderkey")


@query("nearest_rank_p95", "select event_type, value as p95 from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events) where r = ceil(n * 95 / 100.0)")
def nearest_rank_p95(spark, sf_dir):
    return quality.nearest_rank(table(spark, sf_dir, "events"), "value", 95, ["event_type"])
