"""State, validity, lenses, populations, entities, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import folded
from ..operators import entities, evidence, policy, quality
from ..plans.plan import Filter, QueryPlan, Sort
from .base import AS_OF, REGISTRY, engine, query, silver, silver_sql, table

BOND = "issue_date <= date '1998-01-01' and (maturity_date is null or maturity_date >= date '1998-01-01')"
LISTED = """saleable and not suspension_flag and listing_date <= date '1998-01-01' and
    (coalesce(listing_end_date >= date '1998-01-01', false) or (listing_end_date is null and listing_end_date__quality_status in ('missing_blank', 'sentinel_max_date')))"""


def states(kind):
    def run(spark, sf_dir):
        ((_, df),) = engine(spark, sf_dir).frames(QueryPlan("screen", (kind,), AS_OF))[1]
        return df.select("product_id", "eligible")

    return run


query("state_policy_bond", f"select product_id, {BOND} as eligible from {silver_sql('orders')}")(states("order"))
query("state_policy_listed", f"select product_id, {LISTED} as eligible from {silver_sql('orders')}")(states("listed_order"))
query("state_policy_source", f"select product_id, true as eligible from {silver_sql('supplier')}")(states("supplier"))


@query("state_warnings", f"select product_id, case when maturity_date is null then 'bond end state is not source-verifiable' else '' end as warning from {silver_sql('orders')}")
def state_warnings(spark, sf_dir):
    return silver(spark, sf_dir, "orders").select("product_id", F.array_join(policy.warnings("bond"), ",").alias("warning"))


COMPARABLE = "balance__quality_status in ('valid', 'recorded_zero', 'constant_metric') and balance is not null"


@query("metric_validity", f"select product_id, {COMPARABLE} as for_display, coalesce({COMPARABLE} and balance <> 0, false) as for_ranking from {silver_sql('customer')}")
def metric_validity(spark, sf_dir):
    df = silver(spark, sf_dir, "customer").withColumnRenamed("balance__quality_status", policy.status("balance"))
    m = REGISTRY.metrics["account.balance"]
    return df.select("product_id", policy.valid(m, False).alias("for_display"), policy.valid(m, True).alias("for_ranking"))


@query("dual_lens", f"select currency, count(balance) as recorded, count(*) filter ({COMPARABLE}) as comparable, count(balance) <> count(*) filter ({COMPARABLE}) as differs from {silver_sql('customer')} group by currency")
def dual_lens(spark, sf_dir):
    df = silver(spark, sf_dir, "customer").withColumnRenamed("balance__quality_status", policy.status("balance"))
    return policy.dual_lens(df, "balance", policy.valid(REGISTRY.metrics["account.balance"], False), ["currency"])


@query("exclusion_counts", f"select count(*) as all_rows, count(*) filter (not total < 50000) as excluded_by_filter, count(*) filter (total < 50000 and not ({LISTED})) as excluded_by_state, count(*) filter (total < 50000 and ({LISTED})) as included from {silver_sql('orders')}")
def exclusion_counts(spark, sf_dir):
    plan = QueryPlan("screen", ("listed_order",), AS_OF, filters=(Filter("total", "lt", 50000),))
    ((_, df),) = engine(spark, sf_dir).frames(plan)[1]
    return policy.exclusion_counts(df)


@query("exclusion_metric", f"select count(*) as all_rows, count(*) filter (not currency = 'BUILDING') as excluded_by_filter, cast(0 as bigint) as excluded_by_state, count(*) filter (currency = 'BUILDING') as included, count(*) filter (currency = 'BUILDING' and not ({COMPARABLE} and balance <> 0)) as excluded_by_metric, 'customer' as product_type from {silver_sql('customer')}")
def exclusion_metric(spark, sf_dir):
    """Counts of a ranking plan, with the values that it may not compare."""
    plan = QueryPlan("screen_rank", ("customer",), AS_OF, filters=(Filter("currency", "eq", "BUILDING"),), sort=(Sort("balance", True),), metrics=("balance",))
    return engine(spark, sf_dir).run(plan).counts


@query("population_counts", f"select count(*) filter ({COMPARABLE}) as comparable, count(*) filter (balance is null) as missing, count(*) filter (balance = 0) as zero, count(*) as population_rows from {silver_sql('customer')} where currency = 'BUILDING'")
def population_counts(spark, sf_dir):
    plan = QueryPlan("screen", ("customer",), AS_OF, filters=(Filter("currency", "eq", "BUILDING"), Filter("balance", "gt", 3000)))
    ((_, df),) = engine(spark, sf_dir).frames(plan)[1]
    return policy.population_counts(df, "balance", policy.valid(REGISTRY.metrics["account.balance"], False))


@query("source_lens", f"select product_id from {silver_sql('orders')} where total > 250000")
def source_lens(spark, sf_dir):
    """Matched rows before the state policy."""
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("total", "gt", 250000),))
    return engine(spark, sf_dir).run(plan).source.select("product_id")


def zeros_sql(order: str, where: str) -> str:
    """The cut over all recorded values first, then the zeros."""
    return f"""select currency, product_id, "position" from (select *, row_number() over (partition by currency order by {order}) as "position" from {silver_sql('customer')} where balance is not null and {where}) where "position" <= 20 and balance = 0"""


def zeros(spark, sf_dir, descending, *filters):
    plan = QueryPlan("screen_rank", ("customer",), AS_OF, sort=(Sort("balance", descending),), metrics=("balance",), top_k=20, filters=filters)
    ((s, df),) = engine(spark, sf_dir).frames(plan)[1]
    values = policy.metric_values(df, s, REGISTRY, True).withColumn("currency", F.split("partition_key", ":")[1])
    return evidence.recorded_zeros(values, ["currency"], plan.top_k, descending).select("currency", "product_id", "position")


@query("recorded_zeros", zeros_sql("balance, product_id", "balance >= 0"))
def recorded_zeros(spark, sf_dir):
    return zeros(spark, sf_dir, False, Filter("balance", "gte", 0))


@query("recorded_zeros_behind_others", zeros_sql("balance, product_id", "true"))
def recorded_zeros_behind_others(spark, sf_dir):
    """Negative balances come first, so that few zeros or none are in the answer."""
    return zeros(spark, sf_dir, False)


@query("recorded_zeros_descending", zeros_sql("balance desc, product_id desc", "balance < 300"))
def recorded_zeros_descending(spark, sf_dir):
    return zeros(spark, sf_dir, True, Filter("balance", "lt", 300))


@query("evidence_direct", f"""select product_id, value, status, sha256('part' || chr(0) || product_id || chr(0) || 'part.size' || chr(0) || value || chr(0) || status) as evidence_id from (select product_id, cast(size as string) as value, 'valid' as status from {silver_sql('part')} where region = 'PROMO')""")
def evidence_direct(spark, sf_dir):
    plan = QueryPlan("screen", ("part",), AS_OF, filters=(Filter("region", "eq", "PROMO"),), metrics=("size",))
    ((s, df),) = engine(spark, sf_dir).frames(plan)[1]
    return evidence.direct(policy.metric_values(df, s, REGISTRY, False)).select("product_id", "value", "status", "evidence_id")


@query("evidence_summaries", f"select 'exclusions' as kind, 'order' as product_type, unnest(['all_rows', 'excluded_by_filter', 'excluded_by_state', 'included']) as name, unnest([count(*), count(*) filter (not total > 100000), count(*) filter (total > 100000 and not ({BOND})), count(*) filter (total > 100000 and ({BOND}))]) as \"count\" from {silver_sql('orders')}")
def evidence_summaries(spark, sf_dir):
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("total", "gt", 100000),))
    return evidence.summaries(engine(spark, sf_dir).run(plan).counts, "exclusions")


@query("table_difference_is_empty", "select n_nationkey, n_name, n_regionkey, 'left' as only_in from nation where false")
def table_difference_is_empty(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return quality.difference(df, df.orderBy(F.desc("n_name")))


def index(spark, sf_dir):
    return entities.entity_index([silver(spark, sf_dir, t).select(F.lit(t).alias("product_type"), "product_id", F.concat(F.lit(t[:1].upper()), "product_id").alias("other_id"), F.col("product_name").alias("name")) for t in ("customer", "supplier", "part")])


def mentions(spark, *names):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("mention"))


NAMED = f"select 'customer' as product_type, product_id, 'C' || product_id as other_id, product_name as name from {silver_sql('customer')} union all select 'supplier', product_id, 'S' || product_id, product_name from {silver_sql('supplier')} union all select 'part', product_id, 'P' || product_id, product_name from {silver_sql('part')}"


TYPES = ["customer", "supplier", "part"]


def resolved_sql(mentions: list[str], types: list[str]) -> str:
    """Ids give the first product by the order of types, names only a single one; all folded."""
    order = "case product_type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(types)) + " end"
    return f"""with i as ({NAMED}), m as (select unnest({mentions!r}) as mention), f as (
    select mention, product_type, product_id, 1 as p, 'product_id' as matched_by from m join i on lower(mention) = lower(product_id) union select mention, product_type, product_id, 2, 'other_id' from m join i on lower(mention) = lower(other_id)
    union select mention, product_type, product_id, 3, 'exact_name' from m join i on lower(mention) = lower(name)), b as (select mention, min(p) as best from f group by 1),
    k as (select mention, product_type, product_id, matched_by, p, row_number() over (partition by mention order by {order}, product_id) as r, count(*) over (partition by mention) as n from f join b using (mention) where p = best and product_type in ({', '.join(map(repr, types))}))
    select mention, product_type, product_id, matched_by, case when p = 3 then n else 1 end as n_candidates, p < 3 or n = 1 as selected from k where r <= case when p = 3 then 5 else 1 end"""


@query("entity_exact", resolved_sql(["7", "S3", "customer#000000012"], TYPES))
def entity_exact(spark, sf_dir):
    return entities.resolve(mentions(spark, "7", "S3", "customer#000000012"), index(spark, sf_dir), TYPES)


@query("entity_folded_id", resolved_sql(["s3", "c12", "P7", "9"], ["part", "supplier", "customer"]))
def entity_folded_id(spark, sf_dir):
    """Ids in another case, and one id of three types, of which the plan's first is taken."""
    return entities.resolve(mentions(spark, "s3", "c12", "P7", "9"), index(spark, sf_dir), ["part", "supplier", "customer"])


@query("entity_fuzzy", None)
def entity_fuzzy(spark, sf_dir):
    return entities.candidates(mentions(spark, "Custmer 0000123", "part 77"), index(spark, sf_dir), types=TYPES)


@query("folded_names", f"select product_id, lower(product_name) as folded from {silver_sql('customer')}")
def folded_names(spark, sf_dir):
    return silver(spark, sf_dir, "customer").select("product_id", folded(F.col("product_name")).alias("folded"))
