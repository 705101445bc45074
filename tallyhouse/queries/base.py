"""Registration, the silver views of the test tables, and a registry over them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..plans.registry import BETWEEN, CONTAINS, EQ, GT, GTE, IN, LT, LTE, MISSING, NOT_MISSING, STARTS, Field, Metric, ProductType, Registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = date(1998, 1, 1)

DEC = "decimal(38,18)"
#: Columns and expressions that both engines read alike. Nulls, zeros and bad values are put in by key, as the test tables have none.
SILVER: dict[str, dict[str, str]] = {
    "customer": {
        "product_id": "cast(c_custkey as string)", "product_name": "c_name", "currency": "c_mktsegment", "region": "cast(c_nationkey as string)",
        "balance": f"case when c_custkey % 17 <> 0 then cast(cast(case when c_custkey % 13 = 0 then 0 else c_acctbal end as decimal(18,2)) as {DEC}) end",
        "balance__quality_status": "case when c_custkey % 17 = 0 then 'missing_blank' when c_custkey % 13 = 0 then 'recorded_zero' when c_custkey % 11 = 0 then 'out_of_domain' else 'valid' end",
    },
    "supplier": {
        "product_id": "cast(s_suppkey as string)", "product_name": "s_name", "currency": "'MACHINERY'", "region": "cast(s_nationkey as string)",
        "balance": f"cast(cast(s_acctbal as decimal(18,2)) as {DEC})", "balance__quality_status": "case when s_suppkey % 7 = 0 then 'stale' else 'valid' end",
    },
    "part": {
        "product_id": "cast(p_partkey as string)", "product_name": "p_name", "currency": "p_brand", "region": "case when p_partkey % 9 <> 0 then p_type end",
        "price": f"cast(cast(p_retailprice as decimal(18,2)) as {DEC})", "price__quality_status": "'valid'", "size": "cast(p_size as bigint)", "size__quality_status": "'valid'",
    },
    "orders": {
        "product_id": "cast(o_orderkey as string)", "rating": "o_orderpriority", "rating__quality_status": "'valid'", "currency": "o_orderstatus",
        "total": f"cast(cast(o_totalprice as decimal(18,2)) as {DEC})", "total__quality_status": "'valid'", "issue_date": "cast(o_orderdate as date)",
        "maturity_date": "case when o_orderkey % 10 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 900 as int) end",
        "saleable": "o_orderstatus <> 'P'", "suspension_flag": "o_orderkey % 8 = 0", "listing_date": "cast(o_orderdate as date)",
        "listing_end_date": "case when o_orderkey % 6 > 1 then cast(o_orderdate as date) + cast(o_orderkey % 700 as int) end",
        "listing_end_date__quality_status": "case when o_orderkey % 6 = 0 then 'sentinel_max_date' when o_orderkey % 6 = 1 then 'invalid_format' else 'valid' end",
    },
}
PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


def columns(name: str) -> list[str]:
    return [f"{expression} as {column}" for column, expression in SILVER[name].items()]


def silver_sql(name: str) -> str:
    return f"(select {', '.join(columns(name))} from {name})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def silver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns(name))


NUMERIC = (EQ, GT, GTE, LT, LTE, BETWEEN, MISSING, NOT_MISSING)
REGISTRY = Registry(
    {t.name: t for t in (
        ProductType("customer", "customer", "account"), ProductType("supplier", "supplier", "account"), ProductType("part", "part", "part"),
        ProductType("order", "orders", "order", state="bond"), ProductType("listed_order", "orders", "order", state="listed"))},
    {f.name: f for f in (
        Field("product_id", "string", (EQ, IN)), Field("product_name", "string", (EQ, CONTAINS, STARTS), True, (), ("customer", "supplier", "part")),
        Field("currency", "string", (EQ, IN)), Field("region", "string", (EQ, CONTAINS, MISSING, NOT_MISSING), True, (), ("customer", "supplier", "part")),
        Field("issue_date", "date", NUMERIC, True, (), ("order", "listed_order")), Field("maturity_date", "date", NUMERIC, True, (), ("order", "listed_order")),
        Field("balance", "metric", NUMERIC, True, ("min", "max", "avg", "sum")), Field("price", "metric", NUMERIC, True, ("min", "max", "avg", "sum")),
        Field("size", "metric", NUMERIC, True, ("min", "max", "avg")), Field("total", "metric", NUMERIC, True, ("min", "max", "avg", "sum")),
        Field("rating", "metric", (EQ, GTE, LTE, IN, MISSING, NOT_MISSING)))},
    {m.name: m for m in (
        Metric("account.balance", ("customer", "supplier"), "balance", "currency", "snapshot", "balance", "positive_same_currency"),
        Metric("part.price", ("part",), "price", "currency", "snapshot", "price", "valid_numeric_only"),
        Metric("part.size", ("part",), "size", "count", None, "size", "valid_numeric_only", "integer"),
        Metric("order.total", ("order", "listed_order"), "total", "currency", "snapshot", "total", "valid_numeric_only"),
        Metric("order.rating", ("order", "listed_order"), "rating", None, None, "rating", "rated_only", "rating"))},
    PRIORITIES, currency_with=("balance",))


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(REGISTRY, lambda name: silver(spark, sf_dir, name), AS_OF)


def query(name: str, sql: str | None):
    """Register a query under a name, with its SQL (None: not expressible)."""
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put
