"""Strict parsers of raw text columns: each gives struct(value, status).

A value is null unless its text has exactly the expected form; the status says
why. Casts are the ``try_`` kind, so that no row fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)^\s+|\s+$"


def result(value: Column, status: Column) -> Column:
    return F.struct(value.alias("value"), status.alias("status"))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends (``trim`` knows only U+0020)."""
    return F.regexp_replace(c, WHITE, "")


def parse_text(c: Column) -> Column:
    s = strip(c)
    blank = F.coalesce(s == "", F.lit(True))
    return result(F.when(~blank, s), F.when(blank, "missing_blank").otherwise("valid"))


def parse_identifier(c: Column) -> Column:
    """Twelve upper-case letters and digits, nothing else."""
    ok = F.coalesce(c.rlike(r"^[A-Z0-9]{12}\z"), F.lit(False))
    return result(F.when(ok, c), F.when(ok, "valid").otherwise("malformed_source_row"))


def parse_exact_identity(c: Column) -> Column:
    """Not blank, and no white space around it."""
    ok = F.coalesce((c != "") & (c == strip(c)), F.lit(False))
    return result(F.when(ok, c), F.when(ok, "valid").otherwise("malformed_source_row"))


def parse_optional_text(c: Column) -> Column:
    """Like text, and the word NULL (in capitals) is a missing value of its own."""
    s = strip(c)
    blank = F.coalesce(s == "", F.lit(True))
    word = F.coalesce(s == "NULL", F.lit(False))
    return result(F.when(~blank & ~word, s), F.when(blank, "missing_blank").when(word, "missing_literal_null").otherwise("valid"))


def parse_decimal(c: Column, zero_status: str = "recorded_zero") -> Column:
    """A finite decimal of at most 20 integer and 18 fraction digits, without surrounding space; an exponent shifts the digits first."""
    blank = F.coalesce(strip(c) == "", F.lit(True))
    form = F.coalesce(c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?\z"), F.lit(False))
    wide = F.expr("cast(null as decimal(38,18))")
    value = F.when(form, c.try_cast("decimal(38,18)")).otherwise(wide)
    mantissa, shift = F.regexp_extract(c, r"^[+-]?([0-9.]*)", 1), F.coalesce(F.regexp_extract(c, r"[eE]([+-]?[0-9]+)\z", 1).try_cast("int"), F.lit(0))
    fraction = F.length(F.regexp_extract(mantissa, r"\.([0-9]*?)0*\z", 1))
    # trailing zeros of a whole number make room for a negative exponent
    zeros = F.when(fraction == 0, F.length(F.regexp_extract(F.regexp_replace(mantissa, r"\.0*\z", ""), r"(0*)\z", 1))).otherwise(0)
    nothing = ~mantissa.rlike("[1-9]")
    exact = form & value.isNotNull() & ((fraction - zeros - shift <= 18) | nothing)
    kept = F.when(exact & ~blank, value)
    return result(kept, F.when(blank, "missing_blank").when(kept.isNull(), "invalid_format").when(kept == 0, zero_status).otherwise("valid"))


def parse_integer(c: Column, zero_status: str = "recorded_zero") -> Column:
    """An integral decimal; 1.0 is one."""
    d = parse_decimal(c, zero_status)
    whole = F.coalesce(d["value"] == F.floor(d["value"]), F.lit(True))
    return result(F.when(whole, d["value"]).try_cast("bigint"), F.when(whole, d["status"]).otherwise("invalid_format"))


def parse_date(c: Column, open_end: bool = False) -> Column:
    """yyyymmdd; zeros are a sentinel, and so is 99991231 where an open end is allowed."""
    s = c
    blank = F.coalesce(strip(s) == "", F.lit(True))
    zero = F.coalesce(s.isin("0", "00000000"), F.lit(False))
    far = F.coalesce(s == "99991231", F.lit(False)) if open_end else F.lit(False)
    day = F.when(F.coalesce(s.rlike(r"^[0-9]{8}\z"), F.lit(False)), F.try_to_date(s, "yyyyMMdd"))
    day = F.when(~blank & ~zero & ~far, day)
    return result(day, F.when(blank, "missing_blank").when(zero, "sentinel_zero").when(far, "sentinel_max_date").when(day.isNull(), "invalid_format").otherwise("valid"))


def parse_datetime(c: Column) -> Column:
    """yyyy-mm-dd hh:mm:ss without a zone."""
    blank = F.coalesce(strip(c) == "", F.lit(True))
    form = F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"), F.lit(False))
    at = F.when(form, c.try_cast("timestamp_ntz"))
    return result(at, F.when(blank, "missing_blank").when(at.isNull(), "invalid_format").otherwise("valid"))


def parse_flag(c: Column, true: str = "1", false: str = "0") -> Column:
    s = strip(c)
    blank = F.coalesce(s == "", F.lit(True))
    value = F.when(s == true, True).when(s == false, False)
    return result(value, F.when(blank, "missing_blank").when(value.isNull(), "out_of_domain").otherwise("valid"))


def parse_return(c: Column) -> Column:
    """A percentage; below -100 it stays but is out of domain."""
    d = parse_decimal(c)
    return result(d["value"], F.when(d["value"] < -100, "out_of_domain").otherwise(d["status"]))


def parse_currency(c: Column, kind: str) -> Column:
    """By source: three capitals (bond, overseas), a coded name (listed), or one of two (fund)."""
    s = strip(c)
    blank = F.coalesce(s == "", F.lit(True))
    value = {
        "bond": F.when(s.rlike(r"^[A-Z]{3}\z"), s), "overseas": F.when(s.rlike(r"^[A-Z]{3}\z"), s),
        "listed": F.when(s == "CURR_CD_KRW", "KRW"), "fund": F.when(s.isin("KRW", "USD"), s),
    }[kind]
    return result(value, F.when(blank, "missing_blank").when(value.isNull(), "out_of_domain").otherwise("valid"))


def split_codes(c: Column) -> Column:
    """Comma-separated codes; an empty text has none."""
    return F.when(F.coalesce(c == "", F.lit(True)), F.array().cast("array<string>")).otherwise(F.split(c, ","))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start).cast("bigint")


def remaining(maturity: Column, as_of: Column) -> Column:
    """struct(days, matured): from the as-of date; a passed maturity is negative and matured."""
    days = days_between(maturity, as_of)
    return F.struct(days.alias("days"), (days < 0).alias("matured"))


def decimal_text(c: Column) -> Column:
    """A decimal without exponent and without trailing zeros."""
    t = c.cast("decimal(38,18)").cast("string")
    t = F.when(t.rlike("[eE]"), F.format_string("%s", c.cast("decimal(38,18)"))).otherwise(t)
    return F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")


def row_hash(*columns: Column) -> Column:
    """sha-256 of the NUL-joined texts; a null is an empty text."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with keys in order, nulls kept."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def excel_letters(n: int) -> str:
    """A column's letters in a sheet: 1 is A, 27 is AA."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out
