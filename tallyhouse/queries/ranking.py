"""Competition ranks, ties, partitions, top-k, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy
from ..plans.plan import Filter, QueryPlan, Sort
from .base import AS_OF, engine, query, silver, silver_sql

VALID = "balance__quality_status in ('valid', 'recorded_zero', 'constant_metric') and balance <> 0"


@query("rank_competition", f"""select product_id, cast(price as double) as price, "rank", count(*) over (partition by "rank") as tie_count from (
    select product_id, price, rank() over (order by price desc) as "rank" from {silver_sql('part')}) where "rank" <= 5""")
def rank_competition(spark, sf_dir):
    """The flagship: the five highest prices, with all their ties."""
    plan = QueryPlan("screen_rank", ("part",), AS_OF, sort=(Sort("price", True),), metrics=("price",), top_k=5)
    return engine(spark, sf_dir).run(plan).ranks.select("product_id", F.col("sort_value").cast("double").alias("price"), "rank", "tie_count")


@query("rank_ties", f"""select price, count(*) as tie_count from (select cast(price as double) as price from {silver_sql('part')}) group by price having count(*) > 1""")
def rank_ties(spark, sf_dir):
    df = silver(spark, sf_dir, "part").select(F.col("price").cast("double").alias("price"))
    return df.groupBy("price").agg(F.count(F.lit(1)).alias("tie_count")).where("tie_count > 1")


@query("rank_partition", f"""select partition_key, product_id, value, "rank", count(*) over (partition by partition_key, "rank") as tie_count from (
    select 'balance:' || currency || ':snapshot:positive' as partition_key, product_id, cast(balance as double) as value,
    rank() over (partition by currency order by balance) as "rank" from {silver_sql('customer')} where {VALID}) where "rank" <= 10""")
def rank_partition(spark, sf_dir):
    plan = QueryPlan("screen_rank", ("customer",), AS_OF, sort=(Sort("balance"),), metrics=("balance",), top_k=10, top_k_scope="per_product_type")
    return engine(spark, sf_dir).run(plan).ranks.select("partition_key", "product_id", F.col("sort_value").cast("double").alias("value"), "rank", "tie_count")


@query("rank_two_types", f"""select product_type, product_id, "rank" from (select product_type, product_id, rank() over (partition by currency, product_type order by balance desc) as "rank" from (
    select 'customer' as product_type, product_id, currency, balance, balance__quality_status from {silver_sql('customer')} where currency = 'MACHINERY'
    union all select 'supplier', product_id, currency, balance, balance__quality_status from {silver_sql('supplier')}) where {VALID}) where "rank" <= 3""")
def rank_two_types(spark, sf_dir):
    plan = QueryPlan("screen_rank", ("customer", "supplier"), AS_OF, filters=(Filter("currency", "eq", "MACHINERY"),), sort=(Sort("balance", True),), metrics=("balance",), top_k=3, top_k_scope="per_product_type")
    return engine(spark, sf_dir).run(plan).ranks.select("product_type", "product_id", "rank")


@query("rank_two_directions", f"""select 'customer' as product_type, product_id, "rank" from (select product_id, rank() over (partition by currency order by balance desc) as "rank" from {silver_sql('customer')} where {VALID}) where "rank" <= 3
    union all select 'part', product_id, "rank" from (select product_id, rank() over (order by price) as "rank" from {silver_sql('part')}) where "rank" <= 3""")
def rank_two_directions(spark, sf_dir):
    """Each product type by its own sort and direction."""
    plan = QueryPlan("screen_rank", ("customer", "part"), AS_OF, sort=(Sort("balance", True), Sort("price")), top_k=3, top_k_scope="per_product_type")
    return engine(spark, sf_dir).run(plan).ranks.select("product_type", "product_id", "rank")


@query("rank_evidence_cap", f"""select currency, product_id, "rank", "position" from (select currency, product_id, "rank", row_number() over (partition by currency order by "rank", product_id) as "position" from (
    select currency, product_id, rank() over (partition by currency order by price desc) as "rank" from {silver_sql('part')}) where "rank" <= 4) where "position" <= 4""")
def rank_evidence_cap(spark, sf_dir):
    ranked = policy.competition_rank(silver(spark, sf_dir, "part"), "price", ["currency"], True, 4)
    return policy.evidence_rows(ranked, ["currency"], 4).select("currency", "product_id", "rank", "position")


@query("field_rank", f"""select product_id, "rank" from (select product_id, rank() over (order by issue_date) as "rank" from {silver_sql('orders')} where maturity_date is not null) where "rank" <= 50""")
def field_rank(spark, sf_dir):
    df = silver(spark, sf_dir, "orders").where("maturity_date is not null")
    return policy.competition_rank(df, "issue_date", [], False, 50).select("product_id", "rank")


@query("sort_nulls_last", f"""select product_id, cast(balance as double) as balance from {silver_sql('customer')} where currency = 'BUILDING' and region in ('1', '2')
    order by balance desc nulls last, product_id limit 50""")
def sort_nulls_last(spark, sf_dir):
    df = silver(spark, sf_dir, "customer").where("currency = 'BUILDING' and region in ('1', '2')")
    return policy.selection(df, [("balance", True)], 50).select("product_id", F.col("balance").cast("double").alias("balance"))


@query("topk_global", f"select product_id, cast(total as double) as total from {silver_sql('orders')} s where (issue_date <= date '1998-01-01') and (maturity_date is null or maturity_date >= date '1998-01-01') order by s.total desc, product_id limit 20")
def topk_global(spark, sf_dir):
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("total", "is_not_missing"),), sort=(Sort("total", True),), top_k=20)
    return engine(spark, sf_dir).run(plan).rows.select("product_id", F.col("total").cast("double").alias("total"))


@query("topk_per_type", f"""select product_type, product_id from (select product_type, product_id, row_number() over (partition by product_type order by balance desc nulls last, product_id) as n from (
    select 'customer' as product_type, product_id, balance from {silver_sql('customer')} union all select 'supplier', product_id, balance from {silver_sql('supplier')})) where n <= 7""")
def topk_per_type(spark, sf_dir):
    plan = QueryPlan("screen", ("customer", "supplier"), AS_OF, sort=(Sort("balance", True),), top_k=7, top_k_scope="per_product_type")
    return engine(spark, sf_dir).run(plan).rows.select("product_type", "product_id")


@query("envelope_union", f"""select 'customer' as product_type, product_id, product_name, cast(null as double) as price from {silver_sql('customer')} where contains(product_name, '0001')
    union all select 'supplier', product_id, product_name, null from {silver_sql('supplier')} where contains(product_name, '0001')
    union all select 'part', product_id, product_name, cast(price as double) from {silver_sql('part')} where contains(product_name, '0001')""")
def envelope_union(spark, sf_dir):
    plan = QueryPlan("screen", ("customer", "supplier", "part"), AS_OF, filters=(Filter("product_name", "contains", "0001"),), metrics=("price",))
    source = engine(spark, sf_dir).run(plan).source
    return source.select("product_type", "product_id", "product_name", F.col("price").cast("double").alias("price"))
