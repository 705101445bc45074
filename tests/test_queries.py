"""Every query of the catalogue against its SQL in DuckDB, on the smallest test tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyhouse.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("None" if pd.isna(x) else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fuzzy_candidates(spark):
    """All mentions against all names by the plain matcher."""
    from difflib import SequenceMatcher

    from tallyhouse.functions.text import fold
    from tallyhouse.queries.policies import TYPES, index

    names, want = index(spark, SF).select("product_type", "product_id", "name").collect(), []
    for mention in ("Custmer 0000123", "part 77"):
        scored = [(int(SequenceMatcher(None, fold(mention), fold(r.name)).ratio() * 10000), r.product_type, r.product_id) for r in names]
        best = sorted((s for s in scored if s[0] >= 4000), key=lambda s: (-s[0], TYPES.index(s[1]), s[2]))[:5]
        want += [(mention, t, i, s, n) for n, (s, t, i) in enumerate(best, 1)]
    got = QUERIES["entity_fuzzy"](spark, SF).collect()
    assert sorted((r.mention, r.product_type, r.product_id, r.score, r.position) for r in got) == sorted(want)
