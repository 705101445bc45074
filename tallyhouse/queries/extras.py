"""Source lens, reversed selection, contracts, ordered distinct values, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy, quality, scoring
from ..plans.plan import Filter, QueryPlan
from .aggregates import ISSUES, raw_issues
from .base import AS_OF, engine, query, silver, silver_sql, table
from .policies import BOND


@query("source_counts", f"select currency, count(*) filter (total > 200000) as source, count(*) filter (total > 200000 and {BOND}) as validated, count(*) filter (total > 200000) - count(*) filter (total > 200000 and {BOND}) as difference from {silver_sql('orders')} group by currency")
def source_counts(spark, sf_dir):
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("total", "gt", 200000), Filter("currency", "in", ("F", "O", "P"))))
    ((_, df),) = engine(spark, sf_dir).frames(plan)[1]
    return policy.source_counts(df, ["currency"])


@query("source_average", f"select currency, round(cast(sum(balance) as double) / count(balance), 6) as source_average, count(balance) as recorded from {silver_sql('customer')} group by currency")
def source_average(spark, sf_dir):
    return policy.source_average(silver(spark, sf_dir, "customer"), "balance", ["currency"]).withColumn("source_average", F.round(F.col("source_average").cast("double"), 6))


@query("reversed_selection", f"""select currency, product_id, "position" from (select currency, product_id, row_number() over (partition by currency order by price desc, product_id desc) as "position" from {silver_sql('part')}) where "position" <= 6""")
def reversed_selection(spark, sf_dir):
    return policy.reversed_selection(silver(spark, sf_dir, "part"), "price", True, 6, ["currency"]).select("currency", "product_id", "position")


@query("affected_rows", f"select source, count(distinct row_key) as affected_rows, count(distinct row_key) filter (status = 'missing_blank') as quarantined_rows from ({ISSUES}) group by source")
def affected_rows(spark, sf_dir):
    return quality.affected_rows(raw_issues(spark, sf_dir), ["missing_blank"])


@query("ordered_distinct", "select event_type, row_number() over (order by f, event_type) as \"position\" from (select event_type, min(event_id) as f from events group by 1)")
def ordered_distinct(spark, sf_dir):
    return quality.ordered_distinct(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("contract_row_counts", "select 'nation' as table_name, 'row count differs' as problem union all select 'part', 'missing' union all select 'region', 'unexpected'")
def contract_row_counts(spark, sf_dir):
    """Two tables' hashes against an expected contract that asks for one row more of nation, and for part."""
    parts = [quality.table_hash(table(spark, sf_dir, t), list(table(spark, sf_dir, t).columns)).withColumn("table_name", F.lit(t)) for t in ("nation", "region", "supplier")]
    actual = parts[0].unionByName(parts[1]).unionByName(parts[2])
    expected = actual.where("table_name in ('nation', 'supplier')").withColumn("n_rows", F.col("n_rows") + (F.col("table_name") == "nation").cast("bigint"))
    part = spark.range(1).select(F.lit("part").alias("table_name"), F.lit(1).cast("bigint").alias("n_rows"), F.lit("x").alias("table_hash"))
    return quality.contract_problems(actual, expected.select("table_name", "n_rows", "table_hash").unionByName(part))


EXPECTED = "select cast(o_custkey as string) as case_id, cast(o_orderkey as string) as item, o_orderkey as \"position\" from orders"
ACTUAL = "select cast(o_custkey as string) as case_id, cast(o_orderkey as string) as item, case when o_orderkey % 3 = 0 then -o_orderkey else o_orderkey end as \"position\" from orders where o_orderkey % 4 <> 0"


def cases(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").cast("string").alias("item"), F.col("o_orderkey").alias("position"))
    actual = df.where("position % 4 <> 0").withColumn("position", F.when(F.col("position") % 3 == 0, -F.col("position")).otherwise(F.col("position")))
    return df, actual


@query("score_f1", f"with e as ({EXPECTED}), a as ({ACTUAL}) select case_id, case when na > 0 then cast(hit as double) / na else 0.0 end as precision, cast(hit as double) / ne as recall, 2.0 * hit / (ne + na) as f1 from (select e.case_id, count(distinct e.item) as ne, count(distinct a.item) as na, count(distinct a.item) as hit from e left join a on e.case_id = a.case_id and e.item = a.item group by 1)")
def score_f1(spark, sf_dir):
    return scoring.f1(*cases(spark, sf_dir))


@query("score_order", f"""with e as ({EXPECTED}), a as ({ACTUAL}), n as (select case_id, item, lead(item) over (partition by case_id order by "position") as following from e)
    select n.case_id, avg(case when x."position" < y."position" then 1.0::double else 0.0::double end) as order_accuracy from n left join a x on n.case_id = x.case_id and n.item = x.item left join a y on n.case_id = y.case_id and n.following = y.item where following is not null group by 1""")
def score_order(spark, sf_dir):
    return scoring.order_accuracy(*cases(spark, sf_dir))
