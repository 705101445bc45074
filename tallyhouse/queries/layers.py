"""Layers over the test tables: bronze rows, sinks, ratings and other parsers, eligibility, quarantine, cells, holdings."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import evidence, holdings, links, policy, quality
from ..plans.plan import Aggregation, Filter, QueryPlan
from ..sources import layers, normalize
from ..sources.staging import shared_dir, staged
from .base import AS_OF, REGISTRY, engine, query, silver, silver_sql, table
from .parsing import oracle, parsed
from .policies import BOND

#: Raw texts by key, alike in both engines, and what the parsers make of each.
GRADES = [("AAA", "AAA", "valid"), (" AA0 ", "AA0", "valid"), ("AA０", "AA0", "valid"), ("", None, "missing_blank"), ("NR", None, "missing_literal_null"), ("무등급", None, "missing_literal_null"), ("N/A", None, "missing_literal_null"), ("XX", None, "out_of_domain"), ("aaa", None, "out_of_domain")]
MONEY = [("KRW", "KRW", "valid"), ("USD", "USD", "valid"), ("usd", None, "out_of_domain"), ("", None, "missing_blank"), ("KRWX", None, "out_of_domain")]
LISTED_MONEY = [("CURR_CD_KRW", "KRW", "valid"), ("KRW", None, "out_of_domain"), ("", None, "missing_blank")]
FUNDS = [("06", "06", "mixed_source_values"), ("01", "01", "valid"), ("", None, "missing_blank")]
MOMENTS = [("2026-01-02 03:04:05", "2026-01-02 03:04:05", "valid"), ("2026-01-02T03:04:05", None, "invalid_format"), ("2026-02-30 00:00:00", None, "invalid_format"), ("", None, "missing_blank"), ("2026-01-02", None, "invalid_format")]


def quoted(v) -> str:
    return "null" if v is None else "'" + v.replace("'", "''") + "'"


def by_text(name: str, texts: list[tuple[str, str | None, str]], parser) -> None:
    """A query of a parser over texts dealt to the customers, against the table of what each text gives."""
    raw = f"case c_custkey % {len(texts)} " + " ".join(f"when {i} then {quoted(t)}" for i, (t, _, _) in enumerate(texts)) + " end"
    value, status = (f"case raw {' '.join(f'when {quoted(t[0])} then {quoted(t[k])}' for t in texts)} end" for k in (1, 2))
    query(name, oracle(raw, value, status))(parsed(raw, parser))


by_text("parse_rating", GRADES, normalize.rating)
by_text("parse_currency_bond", MONEY, lambda c: P.parse_currency(c, "bond"))
by_text("parse_currency_fund", MONEY, lambda c: P.parse_currency(c, "fund"))
by_text("parse_currency_listed", LISTED_MONEY, lambda c: P.parse_currency(c, "listed"))
by_text("parse_fund_type", FUNDS, normalize.fund_type)
by_text("parse_datetime", MOMENTS, P.parse_datetime)


@query("rating_agencies", "select c_custkey, g as grade, case g when 'AAA' then 'valid' when 'NR' then 'missing_literal_null' when '' then 'missing_blank' else 'out_of_domain' end as status, i as place from (select c_custkey, unnest(string_split(raw, ',')) as g, generate_subscripts(string_split(raw, ','), 1) - 1 as i from (select c_custkey, case when c_custkey % 2 = 0 then 'AAA,NR,,?' else 'NR' end as raw from customer))")
def rating_agencies(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "case when c_custkey % 2 = 0 then 'AAA,NR,,?' else 'NR' end as raw")
    both = F.arrays_zip(F.split("raw", ",").alias("grade"), normalize.ratings(F.col("raw")).alias("p"))
    return df.select("c_custkey", F.posexplode(both).alias("place", "x")).select("c_custkey", F.col("x.grade").alias("grade"), F.col("x.p.status").alias("status"), F.col("place").cast("bigint").alias("place"))


@query("bronze_source_row", """select 'customer' as source_table, c_custkey, '["' || c_custkey || '","' || c_name || '"]' as row_json, sha256(cast(c_custkey as varchar) || chr(0) || c_name) as payload_sha256 from customer""")
def bronze_source_row(spark, sf_dir):
    return layers.source_rows(table(spark, sf_dir, "customer"), "customer", ["c_custkey"], ["c_custkey", "c_name"], datetime(2026, 1, 1)).drop("loaded_at")


@query("bronze_source_column", "select t as source_table, cast(i as bigint) as column_number, chr(cast(64 + i as integer)) as column_letter, c as column_name from (select 'nation' as t, unnest(range(1, 4)) as i, unnest(['n_nationkey', 'n_name', 'n_regionkey']) as c union all select 'region', unnest(range(1, 3)), unnest(['r_regionkey', 'r_name']))")
def bronze_source_column(spark, sf_dir):
    """The columns that the tables themselves declare."""
    return layers.source_columns(spark, {t: list(table(spark, sf_dir, t).columns) for t in ("nation", "region")})


@query("sorted_sink", "select o_orderkey, o_orderpriority, o_custkey from orders")
def sorted_sink(spark, sf_dir):
    """Written in the order of a key and read back under a declared schema."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    path = f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}"
    layers.write_sorted(df, path, ["o_orderpriority", "o_orderkey"])
    return layers.read_declared(spark, path, df.schema)


@query("canonical_json", """select p_partkey, '{"brand":"' || p_brand || '","size":' || case when p_size % 4 = 0 then 'null' else cast(p_size as varchar) end || '}' as text from part""")
def canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.canonical_json({"size": F.when(F.col("p_size") % 4 != 0, F.col("p_size")), "brand": F.col("p_brand")}).alias("text"))


@query("shown_decimal", "select p_partkey, case when contains(t, '.') then regexp_replace(regexp_replace(t, '0+$', ''), '\\.$', '') else t end || '%' as text from (select p_partkey, regexp_replace(format('{:,.2f}', cast(p_retailprice as double)), '^$', '') as t from part)")
def shown_decimal(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", evidence.shown(F.col("p_retailprice").cast("decimal(18,2)"), "percent").alias("text"))


@query("quarantine_split", "select c_custkey, case when c_acctbal > 0 then 'good' else 'bad' end as side from (select c_custkey, case when c_custkey % 5 <> 0 then c_acctbal end as c_acctbal from customer)")
def quarantine_split(spark, sf_dir):
    """A null condition is no good one."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    good, bad = quality.quarantine(df, F.col("c_acctbal") > 0)
    return good.select("c_custkey", F.lit("good").alias("side")).unionByName(bad.select("c_custkey", F.lit("bad").alias("side")))


#: Inputs of the eligibility by key: a null flag or date has the status of its text.
INPUTS = """select o_orderkey, case o_orderkey % 3 when 0 then true when 1 then false end as sale_flag, case when o_orderkey % 3 = 2 then 'out_of_domain' else 'valid' end as sale_flag__quality_status,
    case o_orderkey % 5 when 0 then true when 1 then null else false end as suspension_flag, case when o_orderkey % 5 = 1 then 'missing_blank' else 'valid' end as suspension_flag__quality_status,
    cast(o_orderdate as date) as listing_date, 'valid' as listing_date__quality_status, case when o_orderkey % 4 > 1 then cast(o_orderdate as date) + cast(o_orderkey % 900 as int) end as listing_end_date,
    case o_orderkey % 4 when 0 then 'sentinel_max_date' when 1 then 'invalid_format' else 'valid' end as listing_end_date__quality_status from orders"""


@query("listed_eligibility", f"""with i as ({INPUTS}), r as (select *, sale_flag is false or suspension_flag is true or not listing_date <= date '{AS_OF}' or (listing_end_date__quality_status <> 'sentinel_max_date' and coalesce(listing_end_date < date '{AS_OF}', false)) as ruled_out,
    case when sale_flag is null then sale_flag__quality_status when suspension_flag is null then suspension_flag__quality_status when listing_end_date is null and listing_end_date__quality_status <> 'sentinel_max_date' then listing_end_date__quality_status end as unknown from i)
    select o_orderkey, cast(case when ruled_out then false when unknown is null then true end as varchar) as eligible, case when ruled_out or unknown is null then 'valid' else unknown end as status from r""")
def listed_eligibility(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_as_products")
    df = normalize.listed_eligibility(spark.sql(INPUTS.replace("from orders", "from orders_as_products")), AS_OF)
    return df.select("o_orderkey", F.col("eligible").cast("string").alias("eligible"), F.col("eligible__quality_status").alias("status"))


@query("rating_labels", f"select product_id from {silver_sql('orders')} where rating in ('1-URGENT', '5-LOW') and total > 300000 and ({BOND})")
def rating_labels(spark, sf_dir):
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("rating", "in", ("1-URGENT", "5-LOW")), Filter("total", "gt", 300000)))
    ((_, df),) = engine(spark, sf_dir).frames(plan)[1]
    return df.where("matched and eligible").select("product_id")


@query("rating_equal", f"select product_id from {silver_sql('orders')} where rating = '2-HIGH' and total > 300000 and ({BOND})")
def rating_equal(spark, sf_dir):
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("rating", "eq", "2-HIGH"), Filter("total", "gt", 300000)))
    ((_, df),) = engine(spark, sf_dir).frames(plan)[1]
    return df.where("matched and eligible").select("product_id")


@query("date_texts", f"select product_id from {silver_sql('orders')} where issue_date between date '1995-01-01' and date '1995-03-31' and ({BOND})")
def date_texts(spark, sf_dir):
    """Dates given as texts."""
    plan = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("issue_date", "between", ("1995-01-01", "1995-03-31")),))
    ((_, df),) = engine(spark, sf_dir).frames(plan)[1]
    return df.where("matched and eligible").select("product_id")


@query("aggregate_of_nothing", "select cast(0 as double) as value, cast(0 as bigint) as included_count, count(*) filter (false) as excluded_count from orders")
def aggregate_of_nothing(spark, sf_dir):
    """A count over no row is one row of 0."""
    plan = QueryPlan("aggregate", ("order",), AS_OF, filters=(Filter("total", "lt", -1),), aggregation=Aggregation("count"))
    return engine(spark, sf_dir).run(plan).aggregates.select(F.col("value").cast("double").alias("value"), "included_count", "excluded_count")


@query("display_values", f"select product_id, cast(size as varchar) as value from (select * from {silver_sql('part')} order by product_id limit 5)")
def display_values(spark, sf_dir):
    """The values of the selected rows only."""
    plan = QueryPlan("screen", ("part",), AS_OF, metrics=("size",), top_k=5)
    e = engine(spark, sf_dir)
    ((s, df),) = e.frames(plan)[1]
    return policy.shown_values(policy.metric_values(df, s, REGISTRY, False), e.run(plan).rows).select("product_id", "value")


@query("evidence_by_id", "select 'e' || p_partkey as evidence_id, p_brand as value from part where p_partkey in (3, 5)")
def evidence_by_id(spark, sf_dir):
    facts = table(spark, sf_dir, "part").select(F.concat(F.lit("e"), F.col("p_partkey")).alias("evidence_id"), F.col("p_brand").alias("value"))
    return evidence.point_lookup(facts, ["e5", "e3", "e-1"])


@query("evidence_cells", "select c_custkey as source_row_number, case when c_custkey % 4 = 1 then 'other' else c_name end as raw_identifier, c_custkey % 4 <> 1 and c_custkey % 3 <> 0 as is_matched from customer")
def evidence_cells(spark, sf_dir):
    """Link evidence against the cells of its source by all eleven columns; an unstated date meets an unstated one."""
    df = table(spark, sf_dir, "customer")
    day = F.when(F.col("c_custkey") % 2 == 0, "d")
    values = {c: F.lit("k") for c in links.CELL_KEY} | {"source_row_number": F.col("c_custkey"), "source_applicable_date": day}
    named = df.select(*(v.alias(c) for c, v in values.items()), F.when(F.col("c_custkey") % 4 == 1, "other").otherwise(F.col("c_name")).alias("raw_identifier"))
    cells = df.where("c_custkey % 3 <> 0").select(*(v.alias(c) for c, v in values.items()), F.col("c_name").alias("raw_value"))
    return links.with_cell(named, cells).select("source_row_number", "raw_identifier", "is_matched")


DAY = date(2026, 1, 1)
SOURCE = ("g1", "owner", "issuer", "https://example.org/h", "ab", DAY, DAY)


@query("holding_admission", """select 'repeated row number' as problem, count(*) as n from (select l_orderkey * 10 + l_linenumber from lineitem group by 1 having count(*) > 1) having count(*) > 0
    union all select 'unit that is not declared', count(*) from lineitem where l_returnflag = 'R' having count(*) > 0 union all select 'owner''s coverage is broken', count(*) from (select l_orderkey from lineitem where l_orderkey % 50 = 0 group by 1)
    union all select 'another number of quarantined rows', count(*) from orders where o_orderkey % 100 = 0 having count(*) <> 0""")
def holding_admission(spark, sf_dir):
    """Lines as holdings of their orders: what keeps the generation from being admitted."""
    lines = table(spark, sf_dir, "lineitem")
    lineage = [F.lit(v).alias(c) for c, v in zip(holdings.LINEAGE, SOURCE)]
    held = staged(lines.select(F.lit("order").alias("owner_type"), F.col("l_orderkey").cast("string").alias("owner_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row_ordinal"), F.when(F.col("l_returnflag") == "R", "lots").otherwise("shares").alias("quantity_unit"), F.lit(None).cast("string").alias("market_value_currency"), F.lit(5.0).alias("weight"), F.lit("percent").alias("weight_unit"), *lineage), "holdings")
    seen = held.groupBy("owner_type", "owner_id").agg(F.count(F.lit(1)).alias("k")).select("owner_type", "owner_id", F.lit("complete").alias("coverage_state"), (F.col("k") + F.when(F.col("owner_id").cast("long") % 50 == 0, 1).otherwise(0)).alias("observed_holding_count"), *lineage)
    out = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select((F.col("o_orderkey") * 10 + 9).alias("source_row_ordinal"))
    n, digest = quality.table_hash(held, sorted(held.columns)).first()
    return holdings.admission_problems(holdings.Generation(*SOURCE, DAY, ("quantity:shares", "weight:percent"), n, digest), held, seen, out)


@query("holding_constituents", "select 'isin' as constituent_identifier_type, p_brand as constituent_identifier from part where lower(p_brand) = 'brand#11' group by p_brand")
def holding_constituents(spark, sf_dir):
    """A constituent by its folded name."""
    held = table(spark, sf_dir, "part").select(F.lit("isin").alias("constituent_identifier_type"), F.col("p_brand").alias("constituent_identifier"), F.col("p_brand").alias("constituent_name"))
    return holdings.constituents(held, "bRAND#11").select("constituent_identifier_type", "constituent_identifier")
