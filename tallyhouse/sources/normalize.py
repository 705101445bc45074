"""Raw text tables to silver tables: a declared parser for each field, quarantine of rows without identity, collapse of lots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import collapse
from ..operators.quality import field_issues, quarantine
from ..plans.registry import RATING_MISSING, RATINGS

Parser = Callable[[Column], Column]


def rating(c: Column) -> Column:
    """A rating's label in its canonical width; an empty text is blank, the other missing words are a literal null, unknown ones out of domain."""
    s = F.translate(P.strip(c), "０", "0")
    blank = F.coalesce(s == "", F.lit(True))
    missing, known = F.coalesce(s.isin(*RATING_MISSING), F.lit(True)), F.coalesce(s.isin(*RATINGS), F.lit(False))
    return P.result(F.when(~missing & known, s), F.when(blank, "missing_blank").when(missing, "missing_literal_null").when(~known, "out_of_domain").otherwise("valid"))


def fund_type(c: Column) -> Column:
    """Type 06 mixes sources: the value stays, the status says so."""
    t = P.parse_text(c)
    return P.result(t["value"], F.when(t["value"] == "06", "mixed_source_values").otherwise(t["status"]))


def listed_type(c: Column) -> Column:
    """ETF or ETN, exactly; anything else is no listed product."""
    ok = F.coalesce(c.isin("ETF", "ETN"), F.lit(False))
    return P.result(F.when(ok, c), F.when(ok, "valid").otherwise("malformed_source_row"))


def currency(kind: str) -> Parser:
    return lambda c: P.parse_currency(c, kind)


def code_list(c: Column) -> Column:
    return P.result(P.split_codes(c), F.lit("valid"))


def ratings(c: Column) -> Column:
    """Grades of several agencies, comma-separated: an array of (value, status) in source order."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), ","), rating)


def open_end(c: Column) -> Column:
    return P.parse_date(c, open_end=True)


# fixed values: raw columns of the four sources, their fields and forms
BOND_LOTS: dict[str, tuple[str, Parser]] = {
    "product_id": ("pd_no", P.parse_identifier), "market": ("pd_exg_mkt", P.parse_text), "info_date": ("info_base_dt", P.parse_date), "info_seq": ("info_seq", P.parse_integer),
    "name": ("pd_nm", P.parse_text), "currency": ("curr_cd", currency("bond")), "bond_kind": ("bd_knd", P.parse_text), "issue_date": ("isu_dt", P.parse_date),
    "maturity_date": ("mat_dt", open_end), "coupon_rate": ("srfc_irt", P.parse_decimal), "buy_yield": ("buy_yield", P.parse_decimal), "credit_rating": ("crd_grd", rating),
    "duration": ("dur", P.parse_decimal), "eval_price": ("eval_price", P.parse_decimal), "trade_price": ("trade_price", P.parse_decimal),
}
DOMESTIC_LISTED: dict[str, tuple[str, Parser]] = {
    "product_id": ("pd_itm_no", P.parse_identifier), "product_type": ("pd_grp_no", listed_type), "name": ("pd_nm", P.parse_text), "ticker": ("pd_ticker", P.parse_text), "aum_primary": ("pd_net_tamt", P.parse_decimal), "total_fee": ("cu_charge_rt", P.parse_decimal),
    "tracking_error": ("du_chas_errt", P.parse_decimal), "return_1m": ("du_er_1m", P.parse_decimal), "return_3m": ("du_er_3m", P.parse_decimal), "return_6m": ("du_er_6m", P.parse_decimal),
    "return_1y": ("du_er_1y", P.parse_decimal), "return_ytd": ("du_er_ytd", P.parse_decimal), "sale_flag": ("pd_sale_yn", P.parse_flag), "suspension_flag": ("pd_tr_yn", P.parse_flag),
    "listing_date": ("pd_lstg_dt", P.parse_date), "listing_end_date": ("pd_lste_dt", open_end), "currency": ("pd_curr_cd", currency("listed")),
    "asset_type": ("wu_inv_ast_type", P.parse_text), "region": ("wu_inv_rgn", P.parse_text), "risk_code": ("pd_risk_cd", P.parse_text), "risk_name": ("pd_risk_nm", P.parse_text),
    "listed_share_count": ("pd_lst_stk_cnt", P.parse_decimal), "share_count": ("pd_stk_cnt", P.parse_decimal),
}
OVERSEAS_LISTED: dict[str, tuple[str, Parser]] = {
    "product_id": ("pd_itm_no", P.parse_exact_identity), "product_type": ("pd_grp_no", listed_type), "name": ("pd_nm", P.parse_text), "ticker": ("pd_abrv_nm", P.parse_text), "aum": ("du_last_aum", P.parse_decimal),
    "total_fee": ("cu_charge_rt", P.parse_decimal), "return_1d": ("du_er_1d", P.parse_decimal), "trading_currency": ("pd_trd_ccy", currency("overseas")), "isin": ("pd_isin_cd", P.parse_text),
    "asset_type": ("wu_inv_ast_type", P.parse_text), "region": ("wu_inv_rgn", P.parse_text), "sale_flag_raw": ("pd_sale_yn", P.parse_text), "suspension_flag_raw": ("pd_tr_yn", P.parse_text),
    "source_currency_raw": ("pd_curr_cd", P.parse_text), "market_code": ("pd_mkt_id", P.parse_text), "listing_date": ("pd_lstg_dt", P.parse_date), "close_price": ("du_clpr", P.parse_decimal), "last_nav": ("du_last_nav", P.parse_decimal),
}
#: Fund returns that cannot be below -100; the others, and those of listed products, are kept as they are.
BOUNDED_RETURNS = ("18m", "2y", "3y", "5y")
PUBLIC_FUNDS: dict[str, tuple[str, Parser]] = {
    "fund_item_id": ("itm_no", P.parse_exact_identity), "name": ("itm_nm", P.parse_text), "net_assets": ("fd_nast_suma", P.parse_decimal), "currency": ("curr_cd", currency("fund")),
    "ksd_id": ("ksd_itm_no", P.parse_text), "risk_code": ("zrin_fd_ivst_risk_gcd", P.parse_optional_text), "risk_name": ("zrin_fd_ivst_risk_grd_nm", P.parse_optional_text),
    "region_description": ("fd_ivst_rgn_desc", P.parse_text), "sale_status_raw": ("sale_yn", P.parse_text), "mirae_sale_flag_raw": ("thco_sale_yn", P.parse_text), "fund_type_raw": ("or_attr_desc", fund_type),
    "attribute_codes": ("prfd_attr_cds", code_list), "attribute_count": ("prfd_attr_cnt", P.parse_integer), "family_candidate_key": ("rptt_ksd_itm_no", P.parse_text),
} | {f"return_{k}": (f"fd_{c}_ern_r", P.parse_return if k in BOUNDED_RETURNS else P.parse_decimal) for k, c in {"1w": "wk1", "1m": "mm1", "3m": "mm3", "6m": "mm6", "18m": "mm18", "1y": "yr1", "2y": "yr2", "3y": "yr3", "5y": "yr5"}.items()}


def parsed(df: DataFrame, spec: dict[str, tuple[str, Parser]], keep: list[str] = ()) -> DataFrame:
    """Each field and its quality status, in one projection."""
    structs = df.select(*keep, *(p(F.col(raw)).alias(f) for f, (raw, p) in spec.items()))
    return structs.select(*keep, *(c for f in spec for c in (F.col(f)["value"].alias(f), F.col(f)["status"].alias(f"{f}__quality_status"))))


def normalised(df: DataFrame, spec: dict[str, tuple[str, Parser]], identity: str, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid identity, and the quarantined others."""
    return quarantine(parsed(df, spec, list(keep)), F.col(f"{identity}__quality_status") == "valid")


@dataclass(frozen=True)
class Source:
    """How a raw table becomes a silver one: fields, the identity, and the fields without which a row is quarantined."""

    spec: dict[str, tuple[str, Parser]]
    silver: str
    identity: str = "product_id"
    required: tuple[str, ...] = ()


# fixed values: the four source tables and their silver tables
SOURCES = {
    "PRBD01N001": Source(BOND_LOTS, "silver_bond_sale_lot"),
    "PREF01N001": Source(DOMESTIC_LISTED, "silver_domestic_listed_product", required=("product_type",)),
    "PREF02N001": Source(OVERSEAS_LISTED, "silver_overseas_listed_product", required=("product_type",)),
    "PRFD01N001": Source(PUBLIC_FUNDS, "silver_fund_item", "fund_item_id"),
}


def silver_tables(raw: dict[str, DataFrame], as_of: date, row: str = "source_row") -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """Silver tables by name, quarantined rows by source table, and the issues of all raw tables given.

    raw: source table to its rows as texts, with their number in ``row``. Bond
    lots also give the instruments, domestic products their eligibility. A
    value's issue is a warning, one of an identity or a required field blocks
    its row. Everything is lazy: one scan a source for each result that is used.
    """
    tables, quarantined, found = {}, {}, None
    for name, df in raw.items():
        if name not in SOURCES:
            raise ValueError(f"unknown source table {name}")
        source = SOURCES[name]
        needed = (source.identity, *source.required)
        ok = reduce(lambda a, b: a & b, (F.col(f"{f}__quality_status") == "valid" for f in needed))
        values = parsed(df, source.spec, [row])
        good, quarantined[name] = quarantine(values, ok)
        if name == "PREF01N001":
            good = listed_eligibility(good, as_of)
        if name == "PRFD01N001":  # a count that differs from the list of codes is a mixed value
            differs = (F.col("attribute_count__quality_status") != "invalid_format") & ~F.col("attribute_count").eqNullSafe(F.size("attribute_codes").cast("bigint"))
            good = good.withColumn("attribute_count__quality_status", F.when(differs, "mixed_source_values").otherwise(F.col("attribute_count__quality_status")))
        tables[source.silver] = good
        if name == "PRBD01N001":
            tables["silver_bond_instrument"] = instruments(good, as_of, row)
            own = collapse.conflict_issues(good, name, "product_id", {f: source.spec[f][0] for f in PARENT_FIELDS}, "bond.parent_field_conflict")
            found = own if found is None else found.unionByName(own)
        for rows, fields, severity in ((good, [f for f in source.spec if f not in needed], "warning"), (quarantined[name], needed, "blocker")):
            own = field_issues(rows, name, row, {f: source.spec[f][0] for f in fields}, severity)
            found = own if found is None else found.unionByName(own)
    return tables, quarantined, found


#: Fields of an instrument on which its lots have to agree.
PARENT_FIELDS = ("name", "currency", "bond_kind", "issue_date", "maturity_date", "coupon_rate", "credit_rating")


def with_remaining_days(df: DataFrame, as_of: date) -> DataFrame:
    """Days to maturity at the date, with the maturity's status carried over."""
    days = P.days_between(F.col("maturity_date"), F.lit(as_of))
    return df.withColumns({"remaining_days_at_as_of": days, "remaining_days_at_as_of__quality_status": F.col("maturity_date__quality_status"), "remaining_days_at_as_of__as_of_date": F.lit(as_of)})


def instruments(lots: DataFrame, as_of: date, row: str = "source_row") -> DataFrame:
    """Bond lots to one instrument each: the lot of highest yield, fields on which lots differ set to mixed, the range of yields.

    All group results come from one aggregation keyed by the product.
    """
    ties = [F.col(c).asc_nulls_last() for c in ("market", "info_date", "info_seq", row)]
    best = collapse.best_row(lots, ["product_id"], "buy_yield", ties)
    shared = PARENT_FIELDS
    kinds = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"_n_{c}") for c in shared]
    group = lots.groupBy("product_id").agg(*kinds, F.count(F.lit(1)).alias("n_lots"), F.struct(F.min("buy_yield").alias("low"), F.max("buy_yield").alias("high")).alias("buy_yield_range"))
    out = best.join(group, "product_id")
    for c in shared:
        mixed = F.col(f"_n_{c}") > 1
        out = out.withColumns({c: F.when(~mixed, F.col(c)), f"{c}__quality_status": F.when(mixed, "mixed_source_values").otherwise(F.col(f"{c}__quality_status"))})
    return with_remaining_days(out.drop(*(f"_n_{c}" for c in shared)), as_of)


def listed_eligibility(df: DataFrame, as_of: date) -> DataFrame:
    """eligible and its status: true, false, or unknown where an input that decides is not valid.

    One input that rules a product out decides alone; else the first input
    without a valid value gives the status.
    """
    parts = {"sale_flag": F.col("sale_flag"), "suspension_flag": ~F.col("suspension_flag"), "listing_date": F.col("listing_date") <= F.lit(as_of), "listing_end_date": F.when(F.col("listing_end_date__quality_status") == "sentinel_max_date", True).otherwise(F.col("listing_end_date") >= F.lit(as_of))}
    ruled_out, unknown = F.lit(False), F.lit(None).cast("string")
    for f, ok in reversed(parts.items()):
        ruled_out = ruled_out | F.coalesce(~ok, F.lit(False))
        unknown = F.when(ok.isNull(), F.col(f"{f}__quality_status")).otherwise(unknown)
    return df.withColumns({"eligible": F.when(ruled_out, False).when(unknown.isNull(), True), "eligible__quality_status": F.when(ruled_out | unknown.isNull(), "valid").otherwise(unknown)})
