"""Parsers over raw texts that both engines derive from keys, hashes, cells and profiles of raw rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import parse as P
from ..sources.layers import source_cells
from .base import query, table

WS = "[ \\t\\n\\r\\f\\v]"
#: Raw texts by key, alike in both engines.
TEXT = "case c_custkey % 6 when 0 then '' when 1 then '  ' when 2 then 'NULL' when 3 then ' ' || c_name || chr(9) when 4 then c_name else c_mktsegment || ' ' end"
NUMBER = "case c_custkey % 9 when 0 then '' when 1 then '0' when 2 then ' 1' when 3 then '1.0' when 4 then 'NaN' when 5 then '-100.01' when 6 then 'x' || cast(c_custkey as string) when 7 then cast(c_custkey as string) || '.5' else cast(c_custkey as string) end"
DAY = "case c_custkey % 8 when 0 then '' when 1 then '0' when 2 then '00000000' when 3 then '99991231' when 4 then '20260230' when 5 then '2024011' when 6 then '2024' || '0' || cast(1 + c_custkey % 9 as string) || '1' || cast(c_custkey % 10 as string) else '19990101' end"
FLAG = "case c_custkey % 5 when 0 then '1' when 1 then '0' when 2 then '' when 3 then 'Y' else ' 1 ' end"
IDENT = "case c_custkey % 4 when 0 then 'KR' || lpad(cast(c_custkey as string), 10, '0') when 1 then 'kr' || lpad(cast(c_custkey as string), 10, '0') when 2 then 'KR1' else 'KR' || lpad(cast(c_custkey as string), 10, '0') || ' ' end"
CODES = "case c_custkey % 3 when 0 then '' when 1 then 'A' else 'A,B,' || cast(c_custkey as string) end"


def parsed(raw: str, parser, to: str = "string"):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{raw} as raw")
        return df.select("c_custkey", parser(F.col("raw")).alias("p")).select("c_custkey", F.col("p.value").cast(to).alias("value"), F.col("p.status").alias("status"))

    return run


def oracle(raw: str, value: str, status: str) -> str:
    return f"select c_custkey, {value} as value, {status} as status from (select c_custkey, raw, trim(raw, chr(9) || chr(10) || chr(13) || ' ') as s from (select c_custkey, {raw} as raw from customer))"


query("parse_text", oracle(TEXT, "nullif(s, '')", "case when s = '' then 'missing_blank' else 'valid' end"))(parsed(TEXT, P.parse_text))
query("parse_optional_text", oracle(TEXT, "nullif(nullif(s, ''), 'NULL')", "case s when '' then 'missing_blank' when 'NULL' then 'missing_literal_null' else 'valid' end"))(parsed(TEXT, P.parse_optional_text))
query("parse_identity", oracle(TEXT, "case when raw <> '' and raw = s then raw end", "case when raw <> '' and raw = s then 'valid' else 'malformed_source_row' end"))(parsed(TEXT, P.parse_exact_identity))
query("parse_identifier", oracle(IDENT, "case when regexp_full_match(raw, '[A-Z0-9]{12}') then raw end", "case when regexp_full_match(raw, '[A-Z0-9]{12}') then 'valid' else 'malformed_source_row' end"))(parsed(IDENT, P.parse_identifier))
FORM = r"regexp_full_match(raw, '[+-]?[0-9]+(\.[0-9]+)?')"
query("parse_decimal", oracle(NUMBER, f"case when {FORM} then cast(raw as double) end", f"case when s = '' then 'missing_blank' when not {FORM} then 'invalid_format' when cast(raw as double) = 0 then 'recorded_zero' else 'valid' end"))(parsed(NUMBER, P.parse_decimal, "double"))
#: Texts with exponents, and the value and status of each.
EXPONENTS = [("1e-20", None, "invalid_format"), ("1.5e-18", None, "invalid_format"), ("1000e-20", "1e-17", "valid"), ("2.50E3", "2500", "valid"), ("0e-30", "0", "recorded_zero"), ("1e20", None, "invalid_format"), ("-12.5e-3", "-0.0125", "valid"), ("5e-18", "5e-18", "valid"), ("1e", None, "invalid_format"), (".5e1", "5", "valid")]
RAW_EXPONENTS = "case c_custkey % 10 " + " ".join(f"when {i} then '{raw}'" for i, (raw, _, _) in enumerate(EXPONENTS)) + " end"
query("parse_decimal_exponent", oracle(RAW_EXPONENTS, "case raw " + " ".join(f"when '{raw}' then cast('{v}' as double)" for raw, v, _ in EXPONENTS if v) + " end", "case raw " + " ".join(f"when '{raw}' then '{s}'" for raw, _, s in EXPONENTS) + " end"))(parsed(RAW_EXPONENTS, P.parse_decimal, "double"))
WHOLE = f"{FORM} and cast(raw as double) = floor(cast(raw as double))"
query("parse_integer", oracle(NUMBER, f"case when {WHOLE} then cast(cast(cast(raw as double) as bigint) as string) end", f"case when s = '' then 'missing_blank' when not ({FORM}) or cast(raw as double) <> floor(cast(raw as double)) then 'invalid_format' when cast(raw as double) = 0 then 'recorded_zero' else 'valid' end".replace(f"not ({FORM}) or cast", f"not ({FORM}) or try_cast").replace("floor(cast", "floor(try_cast").replace("when cast(raw", "when try_cast(raw")))(parsed(NUMBER, P.parse_integer))
query("parse_return", oracle(NUMBER, f"case when {FORM} then cast(raw as double) end", f"case when s = '' then 'missing_blank' when not {FORM} then 'invalid_format' when try_cast(raw as double) < -100 then 'out_of_domain' when try_cast(raw as double) = 0 then 'recorded_zero' else 'valid' end"))(parsed(NUMBER, P.parse_return, "double"))
REAL = "case when regexp_full_match(raw, '[0-9]{8}') then try_strptime(raw, '%Y%m%d') end"
query("parse_date", oracle(DAY, f"case when raw not in ('0', '00000000', '99991231') then strftime({REAL}, '%Y-%m-%d') end", f"case when s = '' then 'missing_blank' when raw in ('0', '00000000') then 'sentinel_zero' when raw = '99991231' then 'sentinel_max_date' when {REAL} is null then 'invalid_format' else 'valid' end"))(parsed(DAY, lambda c: P.parse_date(c, True)))
query("parse_flag", oracle(FLAG, "case s when '1' then 'true' when '0' then 'false' end", "case s when '' then 'missing_blank' when '1' then 'valid' when '0' then 'valid' else 'out_of_domain' end"))(parsed(FLAG, P.parse_flag))


@query("split_codes", f"select c_custkey, len(codes) as n_codes, array_to_string(codes, '|') as codes from (select c_custkey, case when raw = '' then []::varchar[] else string_split(raw, ',') end as codes from (select c_custkey, {CODES} as raw from customer))")
def split_codes(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{CODES} as raw").select("c_custkey", P.split_codes(F.col("raw")).alias("codes"))
    return df.select("c_custkey", F.size("codes").cast("bigint").alias("n_codes"), F.array_join("codes", "|").alias("codes"))


@query("days_diff", "select o_orderkey, date_diff('day', date '1998-01-01', cast(o_orderdate as date)) as days, cast(o_orderdate as date) < date '1998-01-01' as matured from orders")
def days_diff(spark, sf_dir):
    r = P.remaining(F.to_date("o_orderdate"), F.lit(date(1998, 1, 1)))
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.days", "r.matured")


@query("decimal_text", "select p_partkey, case when contains(t, '.') then regexp_replace(regexp_replace(t, '0+$', ''), '\\.$', '') else t end as shown from (select p_partkey, cast(cast(p_retailprice as decimal(18,2)) as string) as t from part)")
def decimal_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.decimal_text(F.col("p_retailprice").cast("decimal(18,2)")).alias("shown"))


@query("row_hash", "select c_custkey, sha256(cast(c_custkey as string) || chr(0) || c_name || chr(0) || case when c_custkey % 5 = 0 then '' else c_mktsegment end) as payload_sha256 from customer")
def row_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", P.row_hash(F.col("c_custkey"), F.col("c_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))).alias("payload_sha256"))


@query("unpivot_cells", " union all ".join(f"select 'customer' as source_table, c_custkey, cast({i} as bigint) as column_number, '{x}' as column_letter, '{c}' as column_name, cast({c} as string) as raw_value from customer" for i, (x, c) in enumerate((("A", "c_custkey"), ("B", "c_name"), ("C", "c_nationkey"), ("D", "c_mktsegment")), 1)))
def unpivot_cells(spark, sf_dir):
    return source_cells(table(spark, sf_dir, "customer"), "customer", ["c_custkey"], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
