"""Closed registries: product types, fields, metrics, ratings. Only what stands here can be queried."""

from __future__ import annotations

from dataclasses import dataclass, field

EQ, NE, GT, GTE, LT, LTE = "eq", "ne", "gt", "gte", "lt", "lte"
IN, NOT_IN, BETWEEN, CONTAINS, STARTS = "in", "not_in", "between", "contains", "starts_with"
MISSING, NOT_MISSING = "is_missing", "is_not_missing"
OPERATORS = (EQ, NE, GT, GTE, LT, LTE, IN, NOT_IN, BETWEEN, CONTAINS, STARTS, MISSING, NOT_MISSING)
AGGREGATES = ("count", "min", "max", "avg", "sum")
INTENTS = ("lookup", "screen", "screen_rank", "aggregate", "compare", "explain", "clarify", "unsupported")

# fixed values: quality statuses, and those whose values may be compared
STATUSES = (
    "valid", "missing_blank", "missing_literal_null", "sentinel_zero", "sentinel_max_date", "recorded_zero", "recorded_zero_unverified",
    "invalid_format", "out_of_domain", "constant_metric", "stale", "mixed_source_values", "malformed_source_row",
)
COMPARABLE = ("valid", "recorded_zero", "constant_metric")

# fixed values: strength of ratings, smaller is stronger
RATINGS = {
    "AAA": 1, "AA+": 2, "AA0": 3, "AA": 3, "AA-": 4, "A+": 5, "A0": 6, "A": 6, "A-": 7, "BBB+": 8, "BBB0": 9, "BBB": 9, "BBB-": 10,
    "BB+": 11, "BB0": 12, "BB": 12, "BB-": 13, "B+": 14, "B0": 15, "B": 15, "B-": 16, "CCC+": 17, "CCC0": 18, "CCC": 18, "CCC-": 19,
    "CC": 20, "C": 21, "D": 22,
}
RATING_MISSING = ("", "NULL", "N/A", "NR", "Not Rated", "무등급")


@dataclass(frozen=True)
class Metric:
    """A measured field of some product types, and with what its values may be compared."""

    name: str
    product_types: tuple[str, ...]
    field: str
    unit: str | None
    period: str | None
    group: str
    ranking_policy: str
    kind: str = "decimal"
    zero_policy: str = "recorded_zero"
    needs_period: bool = False


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    operators: tuple[str, ...]
    sortable: bool = True
    aggregates: tuple[str, ...] = ()
    product_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class ProductType:
    """Where a product type's rows stand. columns: field to column where the names differ; state: name of its state policy."""

    name: str
    table: str
    grain: str
    id_column: str = "product_id"
    discriminator: tuple[str, str] | None = None
    columns: dict[str, str] = field(default_factory=dict)
    state: str = "source_only"
    literals: dict[tuple[str, str], str] = field(default_factory=dict)

    def column(self, name: str) -> str:
        return self.id_column if name == "product_id" else self.columns.get(name, name)


@dataclass(frozen=True)
class Registry:
    product_types: dict[str, ProductType]
    fields: dict[str, Field]
    metrics: dict[str, Metric]
    ratings: dict[str, int]
    currency_with: tuple[str, ...] = ("aum",)
    #: fields whose validated form a product type lacks; queries for them fail.
    unvalidated: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: (field, product types) that are left out of a plan over several types, with the limitation's name.
    prunes: tuple[tuple[str, tuple[str, ...], str], ...] = ()

    def metric_of(self, name: str, product_type: str) -> Metric | None:
        return next((m for m in self.metrics.values() if m.field == name and product_type in m.product_types), None)

    def has(self, name: str, product_type: str) -> bool:
        f = self.fields.get(name)
        if f is None:
            return False
        return self.metric_of(name, product_type) is not None if f.kind == "metric" else not f.product_types or product_type in f.product_types


RANGE = (EQ, GT, GTE, LT, LTE, BETWEEN)
NULLS = (MISSING, NOT_MISSING)
BOND, ETF, ETN = "domestic_bond", "domestic_etf", "domestic_etn"
O_ETF, O_ETN, FUND = "overseas_etf", "overseas_etn", "public_fund"
LISTED, OVERSEAS = (ETF, ETN), (O_ETF, O_ETN)


# fixed values: fields with their operators, metrics with their policies, and the columns they stand in
def _fields() -> dict[str, Field]:
    funds_and_listed = (*LISTED, *OVERSEAS, FUND)
    out = [
        Field("product_name", "string", (EQ, CONTAINS, STARTS)),
        Field("product_id", "string", (EQ, IN)),
        Field("holding_constituent", "string", (EQ,), False, (), funds_and_listed),
        Field("asset_type", "string", (EQ, IN, CONTAINS), True, (), (*LISTED, *OVERSEAS)),
        Field("region", "string", (EQ, IN, CONTAINS), True, (), funds_and_listed),
        Field("currency", "string", (EQ, IN)),
        Field("issue_date", "date", (*RANGE, *NULLS), True, (), (BOND,)),
        Field("maturity_date", "date", (*RANGE, *NULLS), True, (), (BOND,)),
        Field("remaining_days_at_as_of", "metric", RANGE, True, ("min", "max", "avg")),
        Field("credit_rating", "metric", (EQ, GTE, LTE, IN, *NULLS)),
        Field("risk_grade", "string", (EQ, IN, *NULLS), True, (), (FUND,)),
        Field("saleable", "boolean", (EQ,), False, (), funds_and_listed),
        Field("mirae_saleable", "boolean", (EQ,), False, (), (FUND,)),
        Field("aum", "metric", (*RANGE, *NULLS), True, ("min", "max", "avg", "sum")),
    ]
    measured = ["buy_yield", "total_fee", "tracking_error", *(f"return_{p}" for p in ("1d", "1w", "1m", "3m", "6m", "ytd", "1y", "18m", "2y", "3y", "5y"))]
    out += [Field(n, "metric", (*RANGE, *NULLS), True, ("min", "max", "avg")) for n in measured]
    return {f.name: f for f in out}


def _metrics() -> dict[str, Metric]:
    out = [
        Metric("bond.buy_yield", (BOND,), "buy_yield", "percent", "yield_to_maturity_like_source_field", "bond_buy_yield", "valid_numeric_only"),
        Metric("bond.remaining_days_at_as_of", (BOND,), "remaining_days_at_as_of", "day", None, "remaining_days", "valid_derived_only", "integer"),
        Metric("bond.credit_rating", (BOND,), "credit_rating", None, None, "bond_credit_rating", "rated_only", "rating"),
        Metric("domestic_etf.aum", LISTED, "aum", "currency", "snapshot", "aum", "positive_primary_same_currency"),
        Metric("domestic_etf.total_fee", LISTED, "total_fee", "percent", "annual_source_convention", "annual_fee", "valid_numeric_only"),
        Metric("domestic_etf.tracking_error", LISTED, "tracking_error", "percent", "source_convention", "tracking_error", "valid_numeric_only"),
        Metric("overseas_etf.aum", OVERSEAS, "aum", "currency", "source_as_of", "aum", "positive_same_currency"),
        Metric("overseas_etf.total_fee", OVERSEAS, "total_fee", "percent", "annual_source_convention", "annual_fee", "valid_numeric_only"),
        Metric("public_fund.aum", (FUND,), "aum", "currency", "source_snapshot", "aum", "same_currency_fund_item_only"),
    ]
    for prefix, types, periods, policy in (
        ("domestic_etf", LISTED, ("1m", "3m", "6m", "1y", "ytd"), "eligible_product_and_valid_numeric"),
        ("overseas_etf", OVERSEAS, ("1d",), "valid_numeric_only"),
        ("public_fund", (FUND,), ("1w", "1m", "3m", "6m", "18m", "1y", "2y", "3y", "5y"), "fund_item_valid_numeric_sale_policy_when_requested"),
    ):
        out += [Metric(f"{prefix}.return_{p}", types, f"return_{p}", "percent", p, "historical_total_return", policy, needs_period=True) for p in periods]
    return {m.name: m for m in out}


def financial_registry() -> Registry:
    """Bonds, listed products at home and abroad, and public funds."""
    listed = {"aum": "aum_primary", "saleable": "sale_flag", "product_name": "name"}
    overseas = {"currency": "trading_currency", "saleable": "sale_flag_raw", "product_name": "name"}
    fund = {"aum": "net_assets", "region": "region_description", "risk_grade": "risk_name", "saleable": "sale_status_raw", "mirae_saleable": "mirae_sale_flag_raw", "product_name": "name"}
    usa = {("region", "미국"): "United States of America"}
    types = [
        ProductType(BOND, "silver_bond_instrument", "instrument", columns={"product_name": "name"}, state="bond"),
        ProductType(ETF, "silver_domestic_listed_product", "listed_product", discriminator=("product_type", "ETF"), columns=listed, state="listed"),
        ProductType(ETN, "silver_domestic_listed_product", "listed_product", discriminator=("product_type", "ETN"), columns=listed, state="listed"),
        ProductType(O_ETF, "silver_overseas_listed_product", "listed_product", discriminator=("product_type", "ETF"), columns=overseas, literals=usa),
        ProductType(O_ETN, "silver_overseas_listed_product", "listed_product", discriminator=("product_type", "ETN"), columns=overseas, literals=usa),
        ProductType(FUND, "silver_fund_item", "fund_item", id_column="fund_item_id", columns=fund),
    ]
    closed = (*OVERSEAS, FUND)
    return Registry({t.name: t for t in types}, _fields(), _metrics(), RATINGS, unvalidated={"saleable": closed, "mirae_saleable": closed}, prunes=(("return_1y", OVERSEAS, "overseas_return_1y_unavailable"),))
