"""Predicates, projections and deferred filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import policy
from ..operators.predicates import ordinal, test
from ..plans.plan import Filter, QueryPlan, Sort
from .base import AS_OF, PRIORITIES, engine, query, silver, silver_sql


def matched(product_type, *filters, fields=("product_id",)):
    """The ids of all rows that match, through a checked plan."""
    def run(spark, sf_dir):
        plan = QueryPlan("screen", (product_type,), AS_OF, filters=filters)
        return engine(spark, sf_dir).run(plan).source.select(*fields)

    return run


CASES = {
    "filter_eq": ("customer", Filter("currency", "eq", "BUILDING"), "currency = 'BUILDING'"),
    "filter_gt": ("customer", Filter("balance", "gt", 5000), "balance > 5000"),
    "filter_gte": ("customer", Filter("balance", "gte", 0), "balance >= 0"),
    "filter_lt": ("customer", Filter("balance", "lt", 0), "balance < 0"),
    "filter_lte": ("part", Filter("size", "lte", 10), "size <= 10"),
    "filter_between": ("order", Filter("issue_date", "between", ("1996-01-01", "1996-12-31")), "issue_date between date '1996-01-01' and date '1996-12-31'"),
    "filter_in": ("customer", Filter("currency", "in", ("BUILDING", "MACHINERY")), "currency in ('BUILDING', 'MACHINERY')"),
    "filter_contains": ("customer", Filter("product_name", "contains", "00012"), "contains(product_name, '00012')"),
    "filter_starts_with": ("part", Filter("product_name", "starts_with", "blue"), "starts_with(product_name, 'blue')"),
    "filter_is_missing": ("order", Filter("maturity_date", "is_missing"), "maturity_date is null"),
    "filter_is_not_missing": ("part", Filter("region", "is_not_missing"), "region is not null"),
}
TABLE = {"order": "orders"}
for name, (kind, clause, where) in CASES.items():
    query(name, f"select product_id from {silver_sql(TABLE.get(kind, kind))} where {where}")(matched(kind, clause))


@query("filter_ne", f"select product_id from {silver_sql('part')} where region <> 'STANDARD'")
def filter_ne(spark, sf_dir):
    return silver(spark, sf_dir, "part").where(test(Filter("region", "ne", "STANDARD"), F.col("region"), "string")).select("product_id")


@query("filter_not_in", f"select product_id from {silver_sql('part')} where region not in ('STANDARD', 'PROMO')")
def filter_not_in(spark, sf_dir):
    return silver(spark, sf_dir, "part").where(test(Filter("region", "not_in", ("STANDARD", "PROMO")), F.col("region"), "string")).select("product_id")


@query("ordinal_filter", f"select product_id from {silver_sql('orders')} where rating in ('1-URGENT', '2-HIGH', '3-MEDIUM') and issue_date >= date '1997-01-01'")
def ordinal_filter(spark, sf_dir):
    return matched("order", Filter("rating", "gte", "3-MEDIUM"), Filter("issue_date", "gte", date(1997, 1, 1)))(spark, sf_dir)


@query("discriminator_filter", "select cast(o_orderkey as string) as product_id, o_orderstatus as kind from orders where o_orderstatus = 'F' and o_totalprice > 200000")
def discriminator_filter(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000))
    return df.select(F.col("o_orderkey").cast("string").alias("product_id"), F.col("o_orderstatus").alias("kind"))


@query("minimal_projection", f"select product_id, cast(price as double) as price from {silver_sql('part')} where size = 7")
def minimal_projection(spark, sf_dir):
    return matched("part", Filter("size", "eq", 7), Filter("price", "is_not_missing"), fields=("product_id", F.col("price").cast("double")))(spark, sf_dir)


@query("deferred_metric_filter", f"""select count(*) filter (balance > 1000 and currency = 'BUILDING') as matched_rows, count(*) filter (currency = 'BUILDING') as population_rows, count(*) as all_rows
    from {silver_sql('customer')}""")
def deferred_metric_filter(spark, sf_dir):
    plan = QueryPlan("screen", ("customer",), AS_OF, filters=(Filter("balance", "gt", 1000), Filter("currency", "eq", "BUILDING")))
    ((_, df),) = engine(spark, sf_dir).frames(plan)[1]
    return df.agg(F.count_if("matched").alias("matched_rows"), F.count_if("population").alias("population_rows"), F.count(F.lit(1)).alias("all_rows"))


@query("entity_restriction", f"select product_id, product_name from {silver_sql('customer')} where product_id in ('5', '77', '901')")
def entity_restriction(spark, sf_dir):
    plan = QueryPlan("lookup", ("customer",), AS_OF, ids=("5", "77", "901"), sort=(Sort("product_name"),))
    return engine(spark, sf_dir).run(plan).rows.select("product_id", "product_name")


@query("ordinal_rank", f"""select rating, rank() over (order by strength) as "rank", n from (
    select rating, case rating when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 4 else 5 end as strength, count(*) as n from {silver_sql('orders')} group by 1, 2)""")
def ordinal_rank(spark, sf_dir):
    df = silver(spark, sf_dir, "orders").groupBy("rating").agg(F.count(F.lit(1)).alias("n")).withColumn("strength", ordinal(F.col("rating"), PRIORITIES))
    return policy.competition_rank(df, "strength", [], False, 50).select("rating", "rank", "n")
