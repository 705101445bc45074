"""Semi joins, match flags, exact links, coverage, comparisons, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import holdings, links, policy, quality
from ..operators.predicates import semi_exists
from ..plans.plan import QueryPlan
from .base import AS_OF, engine, query, silver, silver_sql, table


@query("semi_exists", "select p_partkey, p_brand from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_suppkey = 7)")
def exists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select("l_partkey")
    return semi_exists(table(spark, sf_dir, "part"), lines, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_brand")



@query("left_match_flag", "select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = 7) as is_matched from orders")
def left_match_flag(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return links.matched(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("nullsafe_join", f"""select a.product_id, coalesce(b.found, false) as is_matched from (select product_id, region, currency from {silver_sql('part')}) a
    left join (select distinct region, currency, true as found from {silver_sql('part')} where size < 3) b on a.region is not distinct from b.region and a.currency = b.currency""")
def nullsafe_join(spark, sf_dir):
    df = silver(spark, sf_dir, "part")
    return links.matched(df.select("product_id", "region", "currency"), df.where("size < 3"), ["region", "currency"], ("region",)).select("product_id", "is_matched")


LEFT = "select cast(c_custkey as string) as id, cast(c_custkey % 400 as string) as raw_identifier from customer"
RIGHT = "select cast(s_suppkey as string) as id, cast(s_suppkey as string) as raw_identifier from supplier"
LINKS = f"select a.id as left_id, b.id as right_id, a.raw_identifier, 'same_key_v1' as rule, sha256('same_key_v1' || chr(0) || '1.0.0' || chr(0) || 'customer' || chr(0) || a.id || chr(0) || 'supplier' || chr(0) || b.id || chr(0) || a.raw_identifier) as link_id from ({LEFT}) a join ({RIGHT}) b using (raw_identifier)"


def linked(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as id", "cast(c_custkey % 400 as string) as raw_identifier")
    b = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as id", "cast(s_suppkey as string) as raw_identifier")
    return links.exact_links(a, b, "same_key_v1", "1.0.0", "customer", "supplier")


@query("exact_link", LINKS)
def exact_link(spark, sf_dir):
    return linked(spark, sf_dir)


@query("link_conflicts", f"with l as ({LINKS}) select 'left' as side, left_id as id, count(distinct right_id) as n_partners from l group by 2 having count(distinct right_id) > 1 union all select 'right', right_id, count(distinct left_id) from l group by 2 having count(distinct left_id) > 1")
def link_conflicts(spark, sf_dir):
    return links.conflicts(linked(spark, sf_dir))


@query("link_evidence", f"with l as ({LINKS}) select link_id, 'left' as role, cast(0 as bigint) as ordinal, left_id as id from l union all select link_id, 'right', 1, right_id from l")
def link_evidence(spark, sf_dir):
    return links.evidence(linked(spark, sf_dir))


@query("link_scan", f"with l as ({LINKS}) select left_id, right_id from l where left_id = '9' or right_id = '9'")
def link_scan(spark, sf_dir):
    return links.of_either_side(linked(spark, sf_dir), "9").select("left_id", "right_id")


@query("link_problems", f"""with l as ({LINKS}), c as (select 'left' as side from l group by left_id having count(distinct right_id) > 1 union all select 'right' from l group by right_id having count(distinct left_id) > 1)
    select 'conflict on the ' || side as problem, count(*) as n from c group by 1 union all select 'number of links', count(*) from l having count(*) <> 217""")
def link_problems(spark, sf_dir):
    return links.problems(linked(spark, sf_dir), 217)


@query("linked_records", f"with l as ({LINKS}) select s_suppkey, s_name, s_nationkey from supplier where cast(s_suppkey as string) in (select right_id from l)")
def linked_records(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").withColumn("id", F.col("s_suppkey").cast("string"))
    return links.linked_records(suppliers, "id", linked(spark, sf_dir), "right_id").drop("id")


COVERED = """select 'customer' as owner_type, cast(c_custkey as string) as owner_id, coalesce(state, 'unavailable') as coverage_state, coalesce(n, 0) as observed_holding_count from customer
    left join (select o_custkey, count(*) as n, case when count(*) > 10 then 'complete' else 'partial_top_10' end as state from orders group by 1) on c_custkey = o_custkey"""


def covered(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(F.lit("customer").alias("owner_type"), F.col("c_custkey").cast("string").alias("owner_id"))
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("owner_id")).agg(F.count(F.lit(1)).alias("observed_holding_count"))
    seen = seen.select(F.lit("customer").alias("owner_type"), "owner_id", F.when(F.col("observed_holding_count") > 10, "complete").otherwise("partial_top_10").alias("coverage_state"), "observed_holding_count")
    return holdings.coverage(owners, seen)


@query("coverage_fill", COVERED)
def coverage_fill(spark, sf_dir):
    return covered(spark, sf_dir)


@query("coverage_counts", f"select owner_type, coverage_state, count(*) as n_owners from ({COVERED}) group by 1, 2")
def coverage_counts(spark, sf_dir):
    return holdings.coverage_counts(covered(spark, sf_dir))


@query("holding_counts", "select 'customer' as owner_type, cast(o_custkey as string) as owner_id, count(*) as n_holdings from orders group by 2")
def holding_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("customer").alias("owner_type"), F.col("o_custkey").cast("string").alias("owner_id"))
    return holdings.holding_counts(rows)


@query("compare_pair", f"""select a.product_id as left_id, b.product_id as right_id, cast(a.price as double) as left_value, cast(b.price as double) as right_value, cast(abs(a.price - b.price) as double) as difference,
    case when a.price > b.price then 'higher' when a.price < b.price then 'lower' else 'equal' end as direction from {silver_sql('part')} a, {silver_sql('part')} b where a.product_id = '3' and b.product_id = '8'""")
def compare_pair(spark, sf_dir):
    out = policy.compared_pairs(silver(spark, sf_dir, "part"), "3", "8", "price")
    return out.select("left_id", "right_id", *(F.col(c).cast("double").alias(c) for c in ("left_value", "right_value", "difference")), "direction")


PAIR = f"select min_by(product_id, product_id) as a, max_by(product_id, product_id) as b, min_by(price, product_id) as x, max_by(price, product_id) as y from {silver_sql('part')} where product_id in ('3', '8')"


@query("compare_plan", f"""select 'part' as product_type, case when y > x then b else a end as product_id, 'price_difference' as field, a || ',' || b as inputs, cast(abs(y - x) as double) as value,
    'comparison:' || sha256('part' || chr(0) || a || chr(0) || b || chr(0) || 'price_difference') || ':price_difference' as evidence_id from ({PAIR})""")
def compare_plan(spark, sf_dir):
    """A comparing plan of two products through the engine."""
    plan = QueryPlan("compare", ("part",), AS_OF, metrics=("price",), ids=("3", "8"))
    out = engine(spark, sf_dir).run(plan).comparison
    return out.select("product_type", "product_id", "field", F.array_join("inputs", ",").alias("inputs"), F.col("value").cast("double").alias("value"), "evidence_id")


@query("except_all_diff", """select n_nationkey, n_regionkey, 'left' as only_in from (select n_nationkey, n_regionkey from nation except all select n_nationkey, n_regionkey % 4 from nation)
    union all select n_nationkey, n_regionkey, 'right' from (select n_nationkey, n_regionkey % 4 as n_regionkey from nation except all select n_nationkey, n_regionkey from nation)""")
def except_all_diff(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return quality.difference(a, a.select("n_nationkey", (F.col("n_regionkey") % 4).alias("n_regionkey")))


@query("intersect_ids", "select o_custkey as id from orders where o_totalprice > 300000 intersect select c_custkey from customer where c_acctbal < 0")
def intersect_ids(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    return a.intersect(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))


@query("out_of_order", "select o_orderkey from (select o_orderkey, o_custkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as before from orders) where o_totalprice < before")
def out_of_order(spark, sf_dir):
    return quality.out_of_order(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", ["o_custkey"]).select("o_orderkey")
