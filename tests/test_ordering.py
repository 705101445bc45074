"""Whole-table order and range comparison against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import ordering, ranges
from tallyhouse.operators.quality import difference, ordered_distinct


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(n, seed=1, hot=0.4):
    rng = random.Random(seed)
    return [(i, None if rng.random() < 0.05 else rng.randint(0, 50) if rng.random() > hot else 7, rng.choice(["a", "é", None, "", "zz"])) for i in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    rows = rows_of(900)
    return spark.createDataFrame(rows, "id int, k int, s string").repartition(6)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))


def test_positions(df):
    got = ordering.positions(df, ["k", "id"])
    assert "SinglePartition" not in plan_of(got)
    assert sorted((r.position, r.id) for r in got.collect()) == [(i, r[0]) for i, r in enumerate(in_order(rows_of(900)), 1)]
    tied = [r.position for r in ordering.positions(df, ["s"]).collect()]
    assert sorted(tied) == list(range(1, 901))


def test_positions_of_an_empty_table(df):
    assert ordering.positions(df.limit(0), ["k"]).collect() == []
    assert ordering.order_breaks(df.limit(0), ["k"], ["id"]).collect() == []
    assert ordering.ordered_hash(df.limit(0), ["k"], ["id"]).first() == (0, "0" * 32)


def test_ordered_distinct(df):
    first = {}
    for i, k, _ in rows_of(900):
        first[k] = min(first.get(k, i), i)
    got = ordered_distinct(df, "k", "id")
    assert {r.k: r.position for r in got.collect()} == {k: i for i, (k, _) in enumerate(sorted(first.items(), key=lambda x: x[1]), 1)}
    assert "SinglePartition" not in plan_of(got)


def test_order_breaks(df):
    rows = in_order(rows_of(900))
    want = [(r[0], b[0]) for b, r in zip(rows, rows[1:]) if r[0] < b[0]]
    got = ordering.order_breaks(df, ["k", "id"], ["id"])
    assert sorted((r.key.id, r.before.id) for r in got.collect()) == sorted(want)
    assert ordering.order_breaks(df, ["k", "id"], ["k", "id"]).isEmpty()


def test_file_order(spark, tmp_path):
    rows = [(i,) for i in range(1000)]
    rows[400], rows[900] = rows[900], rows[400]
    spark.createDataFrame(rows, "id int").coalesce(1).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/t")
    read = ordering.file_order(spark.read.parquet(f"{tmp_path}/t"))
    broken = ordering.order_breaks(read, ["file_path", "row_index"], ["id"]).collect()
    assert sorted(r.row_index for r in broken) == [401, 900]


def plain_hash(hashes):
    out = []
    for k, (m, b) in enumerate(zip(ordering.MODULI, ordering.MULTIPLIERS)):
        x = 0
        for h in hashes:
            x = (x * b + (int(h[8 * k : 8 * k + 8], 16) & 0x7FFFFFFF)) % m
        out.append(x)
    return tuple(out)


def test_ordered_hash(df, spark):
    import hashlib

    h = [hashlib.sha256(f"{r[0]}\0{'' if r[2] is None else r[2]}".encode()).hexdigest() for r in in_order(rows_of(900))]
    want = (900, "".join(f"{v:08x}" for v in plain_hash(h)))
    assert tuple(ordering.ordered_hash(df, ["k", "id"], ["id", "s"]).first()) == want
    assert tuple(ordering.ordered_hash(df.repartition(3, "s"), ["k", "id"], ["id", "s"]).first()) == want  # another partitioning
    swapped = df.withColumn("id2", F.when(F.col("id") == 3, 8).when(F.col("id") == 8, 3).otherwise(F.col("id")))
    assert tuple(ordering.ordered_hash(swapped, ["id2"], ["id", "s"]).first()) != tuple(ordering.ordered_hash(df, ["id"], ["id", "s"]).first())


def test_hashes_join():
    h = [f"{random.Random(i).getrandbits(256):064x}" for i in range(40)]
    for cut in (0, 1, 17, 40):
        assert ordering.joined(plain_hash(h[:cut]), plain_hash(h[cut:]), 40 - cut) == plain_hash(h)
    a, b, c = h[:9], h[9:20], h[20:]
    left = ordering.joined(ordering.joined(plain_hash(a), plain_hash(b), 11), plain_hash(c), 20)
    assert left == ordering.joined(plain_hash(a), ordering.joined(plain_hash(b), plain_hash(c), 20), 31)


@pytest.mark.parametrize("key", [["k", "id"], ["s"], ["s", "k"], ["id"]])
def test_changed_rows(spark, df, key):
    a = df.unionByName(df.where("id % 50 = 3"))  # repeated rows
    b = df.withColumn("s", F.when(F.col("id") % 120 == 5, F.lit(None)).otherwise(F.col("s"))).where("id != 77").unionByName(df.where("id = 8"))
    got = ranges.changed_rows(a, b, key, ranges=20)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    want = a.exceptAll(b).withColumn("only_in", F.lit("left")).unionAll(b.exceptAll(a).withColumn("only_in", F.lit("right")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_only_differing_ranges_are_opened(spark, df):
    a, b = df, df.withColumn("s", F.when(F.col("id") == 450, "new").otherwise(F.col("s")))
    at = ranges.bounds(a, ["id"], 20)
    assert len(at) == 19 and at == sorted(at)
    which = ranges.differing(ranges.in_ranges(a, ["id"], at), ranges.in_ranges(b, ["id"], at), a.columns)
    assert len(which) == 1 and at[which[0] - 1][0] <= 450 < at[which[0]][0]
    assert ranges.changed_rows(a, a, ["id"]).isEmpty()
    assert ranges.changed_rows(a.limit(0), a.limit(0), ["id"]).isEmpty()
    assert ranges.changed_rows(a.limit(0), a, ["id"]).count() == 900


@pytest.mark.parametrize("column", ["id", "d", "t", "s", "x", "b"])
def test_every_row_has_one_range(spark, column):
    rows = [(i, f"2020-01-{1 + i % 28:02d}", f"2020-01-01 00:{i % 60:02d}:00", ["é", "", "abcdefgh", "abcdefgi", "日本", "zz"][i % 6], None if i % 9 == 0 else i / 7 - 5) for i in range(300)]
    t = spark.createDataFrame(rows, "id long, d string, t string, s string, x double").selectExpr("id", "cast(d as date) as d", "cast(t as timestamp) as t", "s", "x", "cast(s as binary) as b")
    at = ranges.bounds(t, [column], 8)
    got = ranges.in_ranges(t, [column], at).select("id", column, "range").collect()
    assert sorted(r.id for r in got) == list(range(300))
    key = lambda v: bytes(v) if isinstance(v, (bytes, bytearray)) else v.encode() if isinstance(v, str) else v
    for r in got:
        assert r.range == (0 if r[column] is None else sum(key(x[0]) <= key(r[column]) for x in at))


def test_difference_deals_out_once(spark):
    """Both tables are read once, by one sum over all columns; repeats beyond a block and names of any kind come whole."""
    a = spark.createDataFrame([(1, None)] * 3 + [(2, "x")] * 9_000 + [(3, "")], "`a.b` int, only string")
    b = spark.createDataFrame([(1, None)] * 5 + [(3, None), (2, "x")], "`a.b` int, only string")
    got = difference(a, b)
    assert got.columns == ["a.b", "only", "only_in"] and plan_of(got).count("Exchange hashpartitioning") == 1
    assert {tuple(r): r["count"] for r in got.groupBy("`a.b`", "only", "only_in").count().collect()} == {(1, None, "right", 2): 2, (2, "x", "left", 8_999): 8_999, (3, "", "left", 1): 1, (3, None, "right", 1): 1}
    plan = plan_of(ranges.changed_rows(a.toDF("k", "s"), b.toDF("k", "s"), ["k"], ranges=3))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_range_sums_tell_nulls_apart(spark):
    rows = [(None, "a"), ("a", None), ("", "a"), ("a", ""), (None, None), ("", ""), ("a", "a")]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "range int, s string, t string")
    sums = {tuple(r)[1:] for r in ranges.range_sums(t, ["s", "t"]).collect()}
    assert len(sums) == len(rows)


def test_positions_start_no_worker_of_rows(spark):
    """The ranges' offsets are a local table: no job of Python rows, for which each executor would keep another daemon and workers."""
    found = ordering.positions(spark.range(10), [F.col("id").desc()])
    assert "ExistingRDD" not in plan_of(found)
    assert {(r.id, r.position) for r in found.collect()} == {(i, 10 - i) for i in range(10)}
