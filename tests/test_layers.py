"""Parsers' edge values, normalisation, collapse, holdings, the XLSX source, and sinks."""

import zipfile
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.engine import Engine
from tallyhouse.functions import parse as P
from tallyhouse.functions.text import fold
from tallyhouse.operators import evidence, holdings, links, quality
from tallyhouse.plans.plan import Filter, QueryPlan, Sort
from tallyhouse.plans.registry import financial_registry
from tallyhouse.sources import layers, normalize
from tallyhouse.sources.xlsx import XlsxDataSource


def values(spark, parser, *raw):
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(parser(F.col("raw")).alias("p")).select("p.*")
    return [(r.value, r.status) for r in df.collect()]


def test_parsers(spark):
    assert values(spark, P.parse_text, "", " ", None, "　a　", "x y") == [(None, "missing_blank")] * 3 + [("a", "valid"), ("x y", "valid")]
    assert values(spark, P.parse_optional_text, "NULL", "null") == [(None, "missing_literal_null"), ("null", "valid")]
    assert values(spark, P.parse_identifier, "KR7000000001", "kr7000000001", "KR7000000001\n") == [("KR7000000001", "valid")] + [(None, "malformed_source_row")] * 2
    got = values(spark, P.parse_decimal, "0", " 1", "1.0", "1e3", "NaN", "1_000", "-100.01", "0.1234567890123456789", "123456789012345678901", ".5", "5.")
    assert got[:7] == [(Decimal(0), "recorded_zero"), (None, "invalid_format"), (Decimal(1), "valid"), (Decimal(1000), "valid"), (None, "invalid_format"), (None, "invalid_format"), (Decimal("-100.01"), "valid")]
    assert got[7:9] == [(None, "invalid_format")] * 2 and [g[0] for g in got[9:]] == [Decimal("0.5"), Decimal(5)]
    assert values(spark, P.parse_integer, "1.0", "1.5", "", "7") == [(1, "valid"), (None, "invalid_format"), (None, "missing_blank"), (7, "valid")]
    assert values(spark, P.parse_date, "20260230", "00000000", "0", "", "20240229", "20240229\n", "99991231")[:6] == [(None, "invalid_format"), (None, "sentinel_zero"), (None, "sentinel_zero"), (None, "missing_blank"), (date(2024, 2, 29), "valid"), (None, "invalid_format")]
    assert values(spark, lambda c: P.parse_date(c, True), "99991231") == [(None, "sentinel_max_date")]
    assert values(spark, P.parse_datetime, "2026-01-02 03:04:05", "2026-01-02T03:04:05") == [(datetime(2026, 1, 2, 3, 4, 5), "valid"), (None, "invalid_format")]
    assert values(spark, P.parse_return, "-100.01", "-100") == [(Decimal("-100.01"), "out_of_domain"), (Decimal(-100), "valid")]
    assert values(spark, lambda c: P.parse_currency(c, "listed"), "CURR_CD_KRW", "KRW", "") == [("KRW", "valid"), (None, "out_of_domain"), (None, "missing_blank")]
    assert values(spark, normalize.rating, "AA０", "무등급", "XX", "AA") == [("AA0", "valid"), (None, "missing_literal_null"), (None, "out_of_domain"), ("AA", "valid")]
    assert values(spark, normalize.fund_type, "06", "01") == [("06", "mixed_source_values"), ("01", "valid")]
    assert fold("Ｓtraße  ＡＢ") == "strasse ab"
    assert [P.excel_letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_formats(spark):
    df = spark.createDataFrame([(Decimal("1234567.500"), None)], "v decimal(38,18), x string")
    r = df.select(P.decimal_text(F.col("v")).alias("t"), evidence.shown(F.col("v"), "percent").alias("s"), P.canonical_json({"b": F.col("x"), "a": F.lit(1)}).alias("j")).first()
    assert (r.t, r.s, r.j) == ("1234567.5", "1,234,567.5%", '{"a":1,"b":null}')


def lots(spark):
    names = sorted({raw for raw, _ in normalize.BOND_LOTS.values()})
    base = dict.fromkeys(names, "")

    def row(n, **over):
        return tuple({**base, "pd_no": "KR0000000001", "pd_exg_mkt": "1", "info_base_dt": "20260101", "info_seq": str(n), "pd_nm": "Bond", "curr_cd": "KRW", "isu_dt": "20200101", "mat_dt": "20270101", "crd_grd": "AA", "buy_yield": "3.5", **over}[c] for c in names) + (n,)

    rows = [row(2), row(10, buy_yield="4.0", pd_nm="Bond B"), row(3, buy_yield="4.0"), row(4, buy_yield=""), row(5, pd_no="bad"), row(6, pd_no="KR0000000002", buy_yield="", mat_dt="99991231")]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names) + ", source_row bigint")


def test_bonds(spark):
    good, bad = normalize.normalised(lots(spark), normalize.BOND_LOTS, "product_id", ["source_row"])
    assert bad.count() == 1 and good.count() == 5
    got = {r.product_id: r for r in normalize.instruments(good, date(2026, 8, 24)).collect()}
    one, two = got["KR0000000001"], got["KR0000000002"]
    assert one.info_seq == 3 and one.buy_yield == 4 and one.n_lots == 4 and one.name is None and one.name__quality_status == "mixed_source_values" and one.currency == "KRW"
    assert one.remaining_days_at_as_of == 130 and (one.buy_yield_range.low, one.buy_yield_range.high) == (Decimal("3.5"), Decimal(4))
    assert two.buy_yield is None and two.remaining_days_at_as_of is None and two.maturity_date__quality_status == "sentinel_max_date"


@pytest.mark.parametrize("spec, identity", [(normalize.DOMESTIC_LISTED, "product_id"), (normalize.OVERSEAS_LISTED, "product_id"), (normalize.PUBLIC_FUNDS, "fund_item_id")])
def test_other_sources(spark, spec, identity):
    names = sorted({raw for raw, _ in spec.values()})
    ident = spec[identity][0]
    rows = [tuple("KR0000000001" if c == ident else "ETF" if c == "pd_grp_no" else "1" for c in names), tuple("" for _ in names)]
    good, bad = normalize.normalised(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)), spec, identity)
    assert good.count() == 1 and bad.count() == 1 and len(good.columns) == 2 * len(spec)


def test_bronze(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "n bigint, x string, y string")
    cells = layers.source_cells(df, "t", ["n"], ["x", "y"])
    assert cells.count() == 4 and {(r.column_letter, r.raw_value) for r in cells.where("n = 1").collect()} == {("A", "a"), ("B", "")}
    row = layers.source_rows(df, "t", ["n"], ["x", "y"], datetime(2026, 1, 1)).where("n = 1").first()
    assert row.row_json == '["a",""]' and len(row.payload_sha256) == 64
    assert layers.header_problems(df, ["n", "x", "y"]) == [] and layers.header_problems(df, ["n", "y", "x", "z"])
    assert layers.source_columns(spark, {"t": ["x", "y"]}).count() == 2
    layers.publish(df, str(tmp_path), "pub", "1", ["n"])
    assert spark.table("pub").count() == 2 and layers.file_digests(spark, f"{tmp_path}/pub/version=1/*.parquet").count() >= 1
    assert quality.difference(df, layers.read_declared(spark, f"{tmp_path}/pub/version=1", df.schema)).isEmpty()
    assert quality.table_hash(df, df.columns).first() == quality.table_hash(df.orderBy(F.desc("n")), df.columns).first() != quality.table_hash(df.limit(1), df.columns).first()


def test_holdings(spark):
    held = spark.createDataFrame([("etf", "1", "isin", "A", "Acme Ｃo", 5.0)] * 2 + [("etf", "2", "isin", "B", "Best", 120.0), ("etf", "9", "isin", "B", "Best", 1.0)], "owner_type string, owner_id string, constituent_identifier_type string, constituent_identifier string, constituent_name string, weight double")
    seen = spark.createDataFrame([("etf", "1", "complete", 2), ("etf", "2", "partial_top_10", 3)], "owner_type string, owner_id string, coverage_state string, observed_holding_count bigint")
    full = holdings.coverage(spark.createDataFrame([("etf", "1"), ("etf", "2"), ("etf", "3")], "owner_type string, owner_id string"), seen)
    assert {r.owner_id: r.coverage_state for r in full.collect()} == {"1": "complete", "2": "partial_top_10", "3": "unavailable"}
    assert {(r.owner_id, r.problem) for r in holdings.violations(held, full).collect()} == {("2", "count differs"), ("2", "weight out of range"), ("9", "holding without coverage")}
    assert [r.constituent_identifier for r in holdings.constituents(held, "acme co").collect()] == ["A"]
    assert [r.constituent_identifier for r in holdings.constituents(held, "B").collect()] == ["B"]


def test_no_holdings_at_all(spark):
    none = spark.createDataFrame([], "owner_type string, owner_id string, constituent_identifier_type string, constituent_identifier string, constituent_name string")
    assert [tuple(r) for r in holdings.constituents(none, "Acme").collect()] == [("query_text_exact", "Acme", 3)]


def test_admission(spark):
    day = date(2026, 1, 1)
    source = ("g1", "owner", "issuer", "https://example.org/h", "ab", day, day)
    lineage = "generation_id string, source_owner string, source_kind string, direct_source_url string, raw_file_sha256 string, source_as_of_date date, publication_date date"
    held_schema = "owner_type string, owner_id string, source_row_ordinal bigint, quantity_unit string, market_value_currency string, weight double, weight_unit string, " + lineage
    seen_schema = "owner_type string, owner_id string, coverage_state string, observed_holding_count bigint, " + lineage
    rows = [("etf", "1", 1, "shares", None, 5.0, "percent", *source), ("etf", "1", 2, None, "KRW", None, None, *source)]
    held, seen, out = spark.createDataFrame(rows, held_schema), spark.createDataFrame([("etf", "1", "complete", 2, *source)], seen_schema), spark.createDataFrame([(3,)], "source_row_ordinal bigint")
    n, digest = quality.table_hash(held, sorted(held.columns)).first()
    good = holdings.Generation(*source, day, ("quantity:shares", "market_value:KRW", "weight:percent"), n, digest, 1)

    def problems(g=good, h=held, o=seen, q=out):
        return {r.problem for r in holdings.admission_problems(g, h, o, q).collect()}

    assert problems() == set()
    assert problems(replace(good, units=("quantity:shares",))) == {"unit that is not declared"}
    assert problems(replace(good, cutoff_date=date(2025, 1, 1), direct_source_url="http://x")) == {"dated after the cut-off", "no direct https address", "holding of another source", "coverage of another source"}
    assert problems(replace(good, n_quarantined=0), q=out.limit(0)) == set() and problems(q=out.limit(0)) == {"another number of quarantined rows"}
    assert problems(q=held.select("source_row_ordinal").limit(1)) == {"repeated row number"}
    assert problems(h=held.limit(1)) == {"holdings differ from those declared", "owner's coverage is broken"}
    assert problems(o=seen.unionByName(seen)) >= {"repeated owner"}


def raw_table(spark, spec, *rows):
    """Raw rows as texts: the given fields, all others empty."""
    names = sorted({raw for raw, _ in spec.values()})
    full = [tuple({spec[f][0]: v for f, v in r.items()}.get(c, "") for c in names) + (i,) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in names) + ", source_row bigint")


def test_plans_over_normalised_tables(spark):
    """Every product type is asked over the tables that the normalisers make of raw rows."""
    as_of = date(2026, 8, 24)
    listed = {"name": "n", "aum_primary": "10", "total_fee": "0.5", "return_1m": "1", "sale_flag": "1", "suspension_flag": "0", "listing_date": "20200101", "listing_end_date": "99991231", "currency": "CURR_CD_KRW", "region": "KR"}
    overseas = {"name": "o", "aum": "7", "trading_currency": "USD", "region": "United States of America", "asset_type": "Equity", "return_1d": "0.1"}
    raw = {
        "PRBD01N001": raw_table(spark, normalize.BOND_LOTS, {"product_id": "KR0000000001", "name": "b", "currency": "KRW", "buy_yield": "3.5", "issue_date": "20200101", "maturity_date": "20270101", "credit_rating": "AA"}),
        "PREF01N001": raw_table(spark, normalize.DOMESTIC_LISTED, {"product_id": "KR0000000002", "product_type": "ETF", **listed}, {"product_id": "KR0000000003", "product_type": "ETN", **listed, "aum_primary": "0"}, {"product_id": "KR0000000004", "product_type": "REIT", **listed}),
        "PREF02N001": raw_table(spark, normalize.OVERSEAS_LISTED, {"product_id": "AAA", "product_type": "ETF", **overseas}, {"product_id": "BBB", "product_type": "ETN", **overseas}),
        "PRFD01N001": raw_table(spark, normalize.PUBLIC_FUNDS, {"fund_item_id": "F1", "name": "f", "net_assets": "9", "currency": "KRW", "risk_name": "NULL", "region_description": "KR", "attribute_codes": "A,B", "attribute_count": "3", "return_18m": "-200", "fund_type_raw": "06"}),
    }
    tables, quarantined, issues = normalize.silver_tables(raw, as_of)
    assert {k: v.count() for k, v in quarantined.items()} == {"PRBD01N001": 0, "PREF01N001": 1, "PREF02N001": 0, "PRFD01N001": 0}
    found = {(r.source, r.row_key, r.column_name, r.status, r.severity) for r in issues.where("status <> 'missing_blank'").collect()}
    assert found == {
        ("PREF01N001", "1", "pd_lste_dt", "sentinel_max_date", "warning"), ("PREF01N001", "2", "pd_lste_dt", "sentinel_max_date", "warning"), ("PREF01N001", "3", "pd_grp_no", "malformed_source_row", "blocker"),
        ("PRFD01N001", "1", "prfd_attr_cnt", "mixed_source_values", "warning"), ("PRFD01N001", "1", "fd_mm18_ern_r", "out_of_domain", "warning"),
        ("PRFD01N001", "1", "or_attr_desc", "mixed_source_values", "warning"), ("PRFD01N001", "1", "zrin_fd_ivst_risk_grd_nm", "missing_literal_null", "warning")}
    registry = financial_registry()
    engine = Engine(registry, tables.__getitem__, as_of)
    expected = {"domestic_bond": "KR0000000001", "domestic_etf": "KR0000000002", "domestic_etn": "KR0000000003", "overseas_etf": "AAA", "overseas_etn": "BBB", "public_fund": "F1"}
    for kind, product in expected.items():
        fields = [f for f in registry.fields if registry.has(f, kind) and registry.fields[f].sortable]
        for i in range(0, len(fields), 5):  # every field that may be asked of the type
            a = engine.run(QueryPlan("screen", (kind,), as_of, sort=tuple(Sort(f) for f in fields[i:i + 5])))
            assert [r.product_id for r in a.rows.collect()] == [product]
    ranks = engine.run(QueryPlan("screen_rank", ("domestic_etf", "domestic_etn"), as_of, sort=(Sort("aum", True),), metrics=("aum",))).ranks.collect()
    assert [(r.product_id, r.rank) for r in ranks] == [("KR0000000002", 1)]
    abroad = engine.run(QueryPlan("screen", ("overseas_etf",), as_of, filters=(Filter("region", "eq", "미국"),))).rows
    assert [r.product_id for r in abroad.collect()] == ["AAA"]


def test_ratings_of_agencies(spark):
    df = spark.createDataFrame([("AA0,무등급,XX",), (None,)], "c string")
    got = [[tuple(x) for x in r[0]] for r in df.select(normalize.ratings(F.col("c"))).collect()]
    assert got == [[("AA0", "valid"), (None, "missing_literal_null"), (None, "out_of_domain")], [(None, "missing_blank")]]


def test_evidence_of_cells(spark):
    names = [c for c in links.CELL_KEY]
    schema = ", ".join(f"{c} string" for c in names)
    key = tuple("k" for _ in names[:-1])
    ev = spark.createDataFrame([(*key, None, "id1"), (*key, "d", "id1"), (*key, None, "other")], schema + ", raw_identifier string")
    cells = spark.createDataFrame([(*key, None, "id1")], schema + ", raw_value string")
    assert sorted((r.source_applicable_date or "", r.raw_identifier, r.is_matched) for r in links.with_cell(ev, cells).collect()) == [("", "id1", True), ("", "other", False), ("d", "id1", False)]


def test_claims(spark):
    ev = spark.createDataFrame([("e1", "5"), ("e2", None)], "evidence_id string, value string")
    claims = spark.createDataFrame([(1, "e1", "5"), (2, "e1", "6"), (3, "e3", "5"), (4, "e2", None)], "claim_id bigint, evidence_id string, value string")
    assert {r.claim_id for r in evidence.unsupported_claims(claims, ev).collect()} == {2, 3}
    assert evidence.point_lookup(ev, ["e1"]).count() == 1
    with pytest.raises(ValueError):
        evidence.point_lookup(ev, [])
    assert evidence.records_by_id(ev, "evidence_id", ["e2", "e1"]).count() == 2
    for rows, ids in ((ev, ["e1", "e9"]), (ev.unionByName(ev), ["e1"]), (ev, ["e1", "e1"])):
        with pytest.raises(ValueError):
            evidence.records_by_id(rows, "evidence_id", ids)


def book(path, rows, extra="", strings=()):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(rows)}</sheetData></worksheet>{extra}")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(strings)}</sst>")


def inline(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


def test_xlsx(spark, tmp_path):
    spark.dataSource.register(XlsxDataSource)
    path = f"{tmp_path}/a.xlsx"
    head = f'<row r="1">{inline("A1", "id")}{inline("B1", "v")}</row>'
    book(path, [head, f'<row r="2">{inline("A2", "x")}<c r="B2"><v>00012.50</v></c></row>', '<row r="3"><c r="B3" t="s"><v>0</v></c></row>'], strings=["<si><r><t>ri</t></r><r><t>ch</t></r></si>"])

    def read(schema="id string, v string", **options):
        return spark.read.format("xlsx").schema(schema).options(path=path, **options).load()

    assert [tuple(r) for r in read().collect()] == [("x", "00012.50"), ("", "rich")]
    assert read(rows=2).count() == 2
    for bad in (read("v string, id string"), read(rows=3)):
        with pytest.raises(Exception, match="declared|rows"):
            bad.collect()
    for row in ('<row r="2"><c r="A2"><f>1+1</f><v>2</v></c></row>', f'<row r="2">{inline("A2", "x")}{inline("A2", "y")}</row>', f'<row r="2">{inline("C2", "x")}</row>'):
        book(path, [head, row])
        with pytest.raises(Exception, match="formula|repeated|beyond"):
            read().collect()


def test_xlsx_by_sheet_name(spark, tmp_path):
    spark.dataSource.register(XlsxDataSource)
    path, main = f"{tmp_path}/b.xlsx", 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def write(rows, target="worksheets/other.xml", strings=""):
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="r7"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r7" Type="{rel}/worksheet" Target="{target}"/></Relationships>')
            z.writestr("xl/worksheets/other.xml", f"<worksheet {main}><sheetData>{''.join(rows)}</sheetData></worksheet>")
            z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>first</t></si><si><t>last</t></si></sst>")

    def read(name="Data"):
        return [tuple(r) for r in spark.read.format("xlsx").schema("id string").options(path=path, sheet_name=name).load().collect()]

    head = f'<row r="1">{inline("A1", "id")}</row>'
    write([head, '<row r="2"><c r="A2" t="s"><v>1</v></c></row>'])
    assert read() == [("last",)]
    with pytest.raises(Exception, match="0 sheets"):
        read("Other")
    for row, why in (('<row r="2"><c r="A2" t="s"><v>-1</v></c></row>', "no shared text"), ('<row r="2"><c r="A2" t="s"><v>2</v></c></row>', "no shared text"), ('<row r="1"/>', "after row")):
        write([head, row])
        with pytest.raises(Exception, match=why):
            read()
    write([head], "worksheets/missing.xml")
    with pytest.raises(Exception, match="missing"):
        read()


def test_listed_eligibility(spark):
    columns = "sale_flag boolean, sale_flag__quality_status string, suspension_flag boolean, suspension_flag__quality_status string, listing_date date, listing_date__quality_status string, listing_end_date date, listing_end_date__quality_status string"
    on, off = date(2020, 1, 1), date(2030, 1, 1)
    good = [True, "valid", False, "valid", on, "valid", off, "valid"]

    def change(**over):
        names = [c.split()[0] for c in columns.split(", ")]
        return tuple(over.get(n, v) for n, v in zip(names, good))

    rows = [tuple(good), change(sale_flag=False), change(sale_flag=None, sale_flag__quality_status="out_of_domain"), change(sale_flag=None, sale_flag__quality_status="missing_blank", suspension_flag=True), change(listing_end_date=None, listing_end_date__quality_status="sentinel_max_date"), change(listing_end_date=None, listing_end_date__quality_status="invalid_format")]
    got = normalize.listed_eligibility(spark.createDataFrame(rows, columns), date(2026, 8, 24)).select("eligible", "eligible__quality_status").collect()
    assert [tuple(r) for r in got] == [(True, "valid"), (False, "valid"), (None, "out_of_domain"), (False, "valid"), (True, "valid"), (None, "invalid_format")]


def test_scoring(spark, tmp_path):
    from tallyhouse.operators import scoring

    e = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("1", "c", 3), ("2", "x", 1)], "case_id string, item string, position bigint")
    a = spark.createDataFrame([("1", "b", 1), ("1", "a", 2), ("1", "c", 3), ("3", "y", 1)], "case_id string, item string, position bigint")
    assert {r.case_id: r.f1 for r in scoring.f1(e, a).collect()} == {"1": 1.0, "2": 0.0, "3": 0.0}
    assert {r.case_id: r.order_accuracy for r in scoring.order_accuracy(e, a).collect()} == {"1": 0.5}
    (tmp_path / "s.jsonl").write_text('{"case_id": "a", "expected_plan": {"filters": [{"value": 3}, {"value": "x"}]}}\n{"case_id": "a"}\n')
    cases = scoring.read_cases(spark, str(tmp_path / "s.jsonl"))
    assert scoring.repeated_cases(cases).first().n == 2 and '"value":3' in cases.first().expected_plan.replace(" ", "")


def test_contract(spark):
    a = spark.createDataFrame([("t", 1, "h"), ("u", 2, "h"), ("w", 1, "z")], "table_name string, n_rows bigint, table_hash string")
    e = spark.createDataFrame([("t", 1, "h"), ("u", 3, "h"), ("v", 1, "h"), ("w", 1, "h")], "table_name string, n_rows bigint, table_hash string")
    assert {tuple(r) for r in quality.contract_problems(a, e).collect()} == {("u", "row count differs"), ("v", "missing"), ("w", "content differs")}
