"""What goes with an answer: the trace of its pass, its limitations and claims, its packed evidence; roll-ups of issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collapse, context, evidence, limitations, policy, quality
from ..plans.plan import Aggregation, Filter, QueryPlan, Sort
from .aggregates import ISSUES, raw_issues
from .base import AS_OF, REGISTRY, engine, query, silver, silver_sql, table
from .policies import BOND, COMPARABLE

RANKABLE = f"{COMPARABLE} and balance <> 0"


@query("execution_trace", f"""select product_type, 'account' as grain, count(*) as all_rows, count(*) filter (currency = 'MACHINERY') as candidates, count(*) filter (not (currency = 'MACHINERY' and coalesce(balance > 100, false))) as excluded_by_filter,
    cast(0 as bigint) as excluded_by_state, count(*) filter (currency = 'MACHINERY' and balance > 100 and not ({RANKABLE})) as excluded_by_metric, count(*) filter (currency = 'MACHINERY' and balance > 100) as included,
    least(4, count(*) filter (currency = 'MACHINERY' and balance > 100 and {RANKABLE})) as returned
    from (select 'customer' as product_type, currency, balance, balance__quality_status from {silver_sql('customer')} union all select 'supplier', currency, balance, balance__quality_status from {silver_sql('supplier')}) group by product_type""")
def execution_trace(spark, sf_dir):
    """Counts of a ranking over two types, taken in the pass that ranks."""
    plan = QueryPlan("screen_rank", ("customer", "supplier"), AS_OF, filters=(Filter("currency", "eq", "MACHINERY"), Filter("balance", "gt", 100)), sort=(Sort("balance", True),), metrics=("balance",), top_k=4, top_k_scope="per_product_type")
    return engine(spark, sf_dir).traced(plan, most=10**9)[1]


@query("trace_of_states", f"""select 'order' as product_type, 'order' as grain, count(*) as all_rows, count(*) as candidates, count(*) filter (not coalesce(total > 100000, false)) as excluded_by_filter, count(*) filter (total > 100000 and not ({BOND})) as excluded_by_state,
    cast(0 as bigint) as excluded_by_metric, count(*) filter (total > 100000 and ({BOND})) as included, cast(1 as bigint) as returned from {silver_sql('orders')}""")
def trace_of_states(spark, sf_dir):
    """Counts of a screening whose state policy leaves rows out; its one row is the first by id."""
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("total", "gt", 100000),), top_k=1)
    return engine(spark, sf_dir).traced(plan, most=10**9)[1]


def flagged_issues(spark, sf_dir):
    rows = raw_issues(spark, sf_dir).withColumn("rule_version", F.when(F.col("row_key").cast("long") % 3 == 0, "2").otherwise("1"))
    return rows.unionByName(rows.where("source = 'supplier'")).withColumn("quarantined", F.col("status") == "missing_blank")


FLAGGED = f"""i0 as (select *, case when cast(row_key as bigint) % 3 = 0 then '2' else '1' end as rule_version from ({ISSUES})),
    i as (select *, status = 'missing_blank' as quarantined from (select * from i0 union all select * from i0 where source = 'supplier'))"""


@query("issue_rollup_full", f"""with {FLAGGED} select case when grouping(source) = 0 then 'source' when grouping(rule) = 0 then 'rule' when grouping(severity) = 0 then 'severity' when grouping(status) = 0 then 'status' when grouping(quarantined) = 0 then 'quarantined' else 'total' end as dimension,
    coalesce(source, rule, severity, status, cast(quarantined as varchar)) as name, rule_version as version, count(*) as n_issues, count(distinct (source_of, row_key)) as n_rows, count(distinct case when held then (source_of, row_key) end) as n_quarantined_rows
    from (select *, source as source_of, quarantined as held from i) group by grouping sets ((), (source), (rule, rule_version), (severity), (status), (quarantined))""")
def issue_rollup_full(spark, sf_dir):
    return quality.full_rollup(flagged_issues(spark, sf_dir))


@query("conflict_issues", """with g as (select p_brand, count(distinct p_type) as a, count(distinct coalesce('=' || cast(nullif(p_size, 7) as varchar), '')) as b, count(distinct substr(p_brand, 1, 3)) as c from part group by p_brand),
    x as (select p_brand, unnest(['P_TYPE', 'P_SIZE', 'P_MAKER']) as column_name, unnest(['type', 'size', 'maker']) as f, unnest([a, b, c]) as n from g)
    select 'part' as source, p_brand as row_key, column_name, 'mixed_source_values' as status, 'lot.' || f as rule, 'warning' as severity, sha256('part' || chr(0) || p_brand || chr(0) || column_name || chr(0) || 'mixed_source_values' || chr(0) || 'lot.' || f) as issue_id from x where n > 1""")
def conflict_issues(spark, sf_dir):
    """Brands as products of which the parts are lots: the fields on which lots differ."""
    df = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("type"), F.when(F.col("p_size") != 7, F.col("p_size")).alias("size"), F.substring("p_brand", 1, 3).alias("maker"))
    return collapse.conflict_issues(df, "part", "p_brand", {"type": "P_TYPE", "size": "P_SIZE", "maker": "P_MAKER"}, "lot")


@query("evidence_cap_boundary", f"""select currency, product_id, "rank", "position", tie_count > count(*) over (partition by currency, "rank") as at_boundary from (select *, row_number() over (partition by currency order by "rank", product_id) as "position" from (
    select currency, product_id, "rank", count(*) over (partition by currency, "rank") as tie_count from (select currency, product_id, rank() over (partition by currency order by size desc) as "rank" from {silver_sql('part')}) where "rank" <= 6)) where "position" <= 6""")
def evidence_cap_boundary(spark, sf_dir):
    """The first six rows of a ranking with many ties, and whether the cut parts a row's tie group."""
    ranked = policy.competition_rank(silver(spark, sf_dir, "part"), "size", ["currency"], True, 6)
    return evidence.capped(ranked, ["currency"], 6).select("currency", "product_id", "rank", "position", "at_boundary")


RANK_PLAN = QueryPlan("screen_rank", ("customer",), AS_OF, filters=(Filter("balance", "gte", 0),), sort=(Sort("balance"),), metrics=("balance",), top_k=3, top_k_scope="per_product_type")


def rank_limitations(spark, sf_dir):
    e = engine(spark, sf_dir)
    ((s, df),) = e.frames(RANK_PLAN)[1]
    ok = policy.valid(REGISTRY.metrics["account.balance"], True)
    values = policy.metric_values(df, s, REGISTRY, True).withColumn("currency", F.split("partition_key", ":")[1])
    return limitations.limitations(
        RANK_PLAN, e.run(RANK_PLAN), REGISTRY, lens=policy.dual_lens(df.where("matched and eligible"), "balance", ok, ["currency"]), population=policy.population_counts(df, "balance", ok),
        zeros=evidence.recorded_zeros(values, ["currency"], RANK_PLAN.top_k))


LIMITS = f"""c as (select * from {silver_sql('customer')}), m as (select * from c where balance >= 0), r as (select currency, rank() over (partition by currency order by balance) as k from m where {RANKABLE}),
    t as (select currency, count(*) as n from r where k <= 3 group by currency), z as (select currency, balance, row_number() over (partition by currency order by balance, product_id) as p from m),
    f as (select (select count(*) from t) as currencies, (select count(*) from t where n > 3) as over_cut, (select count(*) from m) as recorded, (select count(*) from m where {RANKABLE}) as comparable, (select count(*) from c where balance is null) as missing, (select count(*) from z where p <= 3 and balance = 0) as zeros),
    l as (select 'snapshot' as limitation, '{AS_OF.isoformat()}' as detail union all select 'recorded_and_comparable_differ', comparable || ' of ' || recorded || ' recorded values are comparable' from f where recorded <> comparable
    union all select 'missing_values', missing || ' values are missing' from f where missing > 0 union all select 'ties_across_the_cut', 'in ' || over_cut || ' partitions' from f where over_cut > 0
    union all select 'several_currencies', currencies || ' currencies are not compared' from f where currencies > 1 union all select 'recorded_zeros', zeros || ' recorded zeros are not compared' from f where zeros > 0)"""


@query("limitations", f"with {LIMITS} select * from l")
def limitations_of_a_ranking(spark, sf_dir):
    return rank_limitations(spark, sf_dir)


@query("limitations_of_aggregates", f"""select 'snapshot' as limitation, '{AS_OF.isoformat()}' as detail union all select 'several_currencies', count(distinct currency) || ' currencies are not compared' from {silver_sql('customer')} where {COMPARABLE} having count(distinct currency) > 1
    union all select distinct 'aggregate_is_partial', n || ' included, ' || x || ' left out' from (select count(*) filter ({COMPARABLE} and balance is not null) as n, count(*) filter (not ({COMPARABLE} and balance is not null)) as x from {silver_sql('customer')} group by currency) where n > 0 and x > 0""")
def limitations_of_aggregates(spark, sf_dir):
    plan = QueryPlan("aggregate", ("customer",), AS_OF, aggregation=Aggregation("max", "balance"), top_k_scope="per_product_type")
    return limitations.limitations(plan, engine(spark, sf_dir).run(plan), REGISTRY)


@query("missing_limitations", f"with {LIMITS} select * from l where limitation >= 'n'")
def missing_limitations(spark, sf_dir):
    """An answer that says only the limitations before 'n'."""
    found = rank_limitations(spark, sf_dir)
    claims = found.where("limitation < 'n'").select(F.lit("limitation").alias("kind"), F.concat_ws(": ", "limitation", "detail").alias("value"))
    return evidence.missing_limitations(found, claims)


@query("claim_problems", f"""select product_id as claim_id, case when k = 1 then 'differs from its evidence' when k = 2 then 'unknown evidence' when k = 3 then 'numeric claim without evidence' else 'evidence of another product' end as problem
    from (select product_id, cast(product_id as bigint) % 7 as k from {silver_sql('part')}) where k between 1 and 4""")
def claim_problems(spark, sf_dir):
    """A claim on the size of every part: two in seven hold, a sixth is a sound candidate, the others are wrong in four ways."""
    df = silver(spark, sf_dir, "part").select("product_id", F.col("size").cast("string").alias("value"), (F.col("product_id").cast("long") % 7).alias("k"))
    none = F.array().cast("array<string>")
    facts = df.select(F.concat(F.lit("e"), "product_id").alias("evidence_id"), F.lit("part").alias("product_type"), "product_id", F.lit("part.size").alias("field"), "value", none.alias("groups"))
    own = F.concat(F.lit("e"), "product_id")
    ids = F.when(F.col("k") == 2, F.array(own, F.lit("e?"))).when(F.col("k") == 3, none).otherwise(F.array(own))
    claims = df.select(
        F.col("product_id").alias("claim_id"), F.when(F.col("k").isin(4, 5), "candidate").otherwise("numeric").alias("kind"), ids.alias("evidence_ids"), F.lit("part").alias("product_type"),
        F.when(F.col("k") == 4, "?").otherwise(F.col("product_id")).alias("product_id"), F.when(~F.col("k").isin(4, 5), "part.size").alias("field"), F.when(F.col("k") == 1, "x").otherwise(F.col("value")).alias("value"), none.alias("groups"))
    return evidence.claim_problems(claims, facts)


BUDGET = 20_000
#: Evidence of parts with the brand as source; texts are plain, so that JSON of both engines is alike.
PACKED = f"""k as (select currency as source_table, row_number() over (order by currency) - 1 as source_id from (select distinct currency from {silver_sql('part')})),
    paid as (select sum(octet_length(encode('["' || source_table || '","f","s","c","d"]'))) as n from k), e as (select source_id, 'e' || product_id as evidence_id, product_id, 'f' || size % 3 as field, cast(size as varchar) as value, cast(product_id as bigint) as place from {silver_sql('part')} join k on currency = source_table),
    b as (select *, octet_length(encode('["' || source_id || '","' || evidence_id || '","part","' || product_id || '","' || field || '","' || value || '","valid"]')) as n_bytes from e),
    s as (select *, cast(sum(n_bytes) over (order by place) + (select n from paid) as bigint) as so_far from b)"""


def packed(spark, sf_dir):
    df = silver(spark, sf_dir, "part")
    rows = df.select(
        F.col("currency").alias("source_table"), *(F.lit(v).alias(c) for c, v in (("source_file", "f"), ("source_sheet", "s"), ("source_checksum", "c"), ("source_snapshot_date", "d"))), F.concat(F.lit("e"), "product_id").alias("evidence_id"),
        F.lit("part").alias("product_type"), "product_id", F.concat(F.lit("f"), F.col("size") % 3).alias("field"), F.col("size").cast("string").alias("value"), F.lit("valid").alias("status"), F.col("product_id").cast("long").alias("place"))
    return context.packed_context(rows, ["place"], BUDGET)


@query("context_sources", f"with {PACKED} select source_id, source_table from k")
def context_sources(spark, sf_dir):
    return packed(spark, sf_dir).sources.select("source_id", "source_table")


@query("context_rows", f"with {PACKED} select source_id, evidence_id, n_bytes, so_far from s where so_far <= {BUDGET}")
def context_rows(spark, sf_dir):
    return packed(spark, sf_dir).kept.select("source_id", "evidence_id", "n_bytes", "so_far")


@query("context_overflow", f"with {PACKED} select 'part' as product_type, field, count(*) as n_rows, cast(sum(n_bytes) as bigint) as n_bytes from s where so_far > {BUDGET} group by field")
def context_overflow(spark, sf_dir):
    return packed(spark, sf_dir).overflow
