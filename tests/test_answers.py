"""Traces, limitations, claims, packed evidence, name bounds, roll-ups and source files on hand-made rows."""

import hashlib
import random
from collections import Counter
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.text import fold
from tallyhouse.operators import collapse, context, entities, evidence, limitations, ordering, policy, quality
from tallyhouse.plans.plan import Aggregation, Filter, QueryPlan, Sort
from tallyhouse.queries.base import AS_OF, REGISTRY, engine
from tallyhouse.sources import layers

SF = "/root/testdata/sf0.001"
RANK = QueryPlan("screen_rank", ("customer", "supplier"), AS_OF, filters=(Filter("currency", "eq", "MACHINERY"),), sort=(Sort("balance", True),), metrics=("balance",), top_k=4)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_table_is_read_once(spark, tmp_path):
    """A ranking with its check of partitions, an aggregate with the rows that the state policy left out, and a trace."""
    e = engine(spark, SF)
    assert plan_of(e.run(RANK).ranks).count("FileScan") == 2
    for function in ("count", "max"):
        one = QueryPlan("aggregate", ("order",), AS_OF, filters=(Filter("total", "gt", 1000),), aggregation=Aggregation(function, None if function == "count" else "total"), top_k_scope="per_product_type")
        assert plan_of(e.run(one).aggregates).count("FileScan") == 1
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("traced", "traced")
    rows, trace = e.traced(RANK, f"{tmp_path}/out")
    jobs = before.getJobIdsForGroup("traced")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in jobs for s in before.getJobInfo(j).stageIds}
    assert rows.count() >= 4 and sum(r.returned for r in trace.collect()) == rows.count()
    assert len(stages) <= 8  # two scans, the ranks and the write; nothing is scanned for the counts


def test_trace_agrees_with_counts_and_ranks(spark, tmp_path):
    e = engine(spark, SF)
    rows, trace = e.traced(RANK, f"{tmp_path}/out")
    answer = e.run(RANK)
    counts = {r.product_type: r for r in answer.counts.collect()}
    for t in trace.collect():
        c = counts[t.product_type]
        assert (t.all_rows, t.excluded_by_filter, t.excluded_by_state, t.excluded_by_metric, t.included) == (c.all_rows, c.excluded_by_filter, c.excluded_by_state, c.excluded_by_metric, c.included)
    assert sorted(map(str, rows.collect())) == sorted(map(str, answer.ranks.collect()))


def test_candidate_limit(spark):
    e = engine(spark, SF)
    n = {r.product_type: r.candidates for r in e.traced(RANK)[1].collect()}
    assert e.traced(RANK, most=max(n.values()))[1].count() == 2
    with pytest.raises(Exception, match=policy.TOO_MANY):
        e.traced(RANK, most=max(n.values()) - 1)
    # over all tasks, where no task alone has too many
    many = spark.range(0, 100, 1, 10)
    assert policy.limited(many, 10).count() == 100
    with pytest.raises(Exception, match=policy.TOO_MANY):
        policy.limited(many, 9).count()


def test_global_result_of_two_partitions(spark):
    e = engine(spark, SF)
    two = QueryPlan("screen_rank", ("customer",), AS_OF, sort=(Sort("balance"),), metrics=("balance",), top_k=1)
    with pytest.raises(Exception, match=policy.NOT_ONE):
        e.run(two).ranks.collect()
    with pytest.raises(Exception, match=policy.NOT_ONE):
        e.run(QueryPlan("aggregate", ("customer",), AS_OF, aggregation=Aggregation("sum", "balance"))).aggregates.collect()
    assert e.run(QueryPlan("aggregate", ("part",), AS_OF, filters=(Filter("currency", "eq", "Brand#11"),), aggregation=Aggregation("max", "price"))).aggregates.count() == 1


def test_state_excluded_rows_count_once_per_partition(spark):
    rows = [("a", "KRW", Decimal(1), True), ("b", "KRW", Decimal(3), False), ("c", "USD", Decimal(5), True), ("d", "EUR", Decimal(5), False)]
    df = spark.createDataFrame(rows, "product_id string, partition_key string, v decimal(38,18), eligible boolean")
    got = {r.partition_key: (r.value, r.included_count, r.excluded_count, r.left_out) for r in policy.aggregated(df, "sum", "v", ["partition_key"], None, F.col("eligible")).collect()}
    assert got == {"KRW": (1, 1, 0, 1), "USD": (5, 1, 0, 0), "EUR": (None, 0, 0, 1)}


def test_recorded_zeros_are_cut_first(spark):
    rows = [("g", f"p{i}", Decimal(v), ok) for i, (v, ok) in enumerate([(-2, True), (-1, True), (0, False), (0, False), (3, True), (0, True)])]
    df = spark.createDataFrame(rows, "g string, product_id string, sort_value decimal(38,18), valid boolean")
    ids = lambda k, down=False: [r.product_id for r in evidence.recorded_zeros(df, ["g"], k, down).orderBy("position").collect()]
    assert ids(2) == [] and ids(3) == ["p2"] and ids(4) == ["p2", "p3"] and ids(6) == ["p2", "p3"]
    assert ids(2, True) == [] and ids(3, True) == ["p3"] and ids(4, True) == ["p3", "p2"]  # the ids turn round too


def test_full_rollup(spark):
    schema = "source string, row_key string, rule string, rule_version string, severity string, status string, quarantined boolean"
    rng = random.Random(4)
    rows = [(rng.choice("ab"), str(rng.randint(0, 9)), rng.choice(["r", "s", None]), rng.choice("12"), rng.choice(["warning", "error"]), rng.choice("xyz"), rng.choice([True, False, None])) for _ in range(200)]
    want = {}
    for dimension, key in {"total": lambda r: (None, None), "source": lambda r: (r[0], None), "rule": lambda r: (r[2], r[3]), "severity": lambda r: (r[4], None), "status": lambda r: (r[5], None), "quarantined": lambda r: (None if r[6] is None else str(r[6]).lower(), None)}.items():
        for r in rows:
            of = [x for x in rows if key(x) == key(r)]
            want[dimension, *key(r)] = (len(of), len({x[:2] for x in of}), len({x[:2] for x in of if x[6]}))
    got = quality.full_rollup(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert len(got) == len(want) and {(r.dimension, r.name, r.version): (r.n_issues, r.n_rows, r.n_quarantined_rows) for r in got} == want
    assert [tuple(r) for r in quality.full_rollup(spark.createDataFrame([], schema)).collect()] == []


def test_conflict_issues(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", ""), (2, "b", "x"), (2, "b", "x"), (3, "c", None), (3, "c", None)], "k int, f string, g string")
    got = collapse.conflict_issues(df, "t", "k", {"f": "F", "g": "G"}, "lot").collect()
    assert [(r.row_key, r.column_name, r.status, r.rule) for r in got] == [("1", "G", "mixed_source_values", "lot.g")]


def test_capped_boundary(spark):
    df = spark.createDataFrame([("a", str(i), Decimal(v)) for i, v in enumerate([1, 2, 2, 2, 3])], "g string, product_id string, v decimal(38,18)")
    ranked = policy.competition_rank(df, "v", ["g"], False, 3)
    cut = lambda cap: [(r.product_id, r.at_boundary) for r in evidence.capped(ranked, ["g"], cap).orderBy("position").collect()]
    assert cut(3) == [("0", False), ("1", True), ("2", True)] and cut(4) == [("0", False), ("1", False), ("2", False), ("3", False)]


def test_limitations(spark):
    e = engine(spark, SF)
    rated = QueryPlan("screen", ("order",), AS_OF, filters=(Filter("rating", "gte", "2-HIGH"), Filter("maturity_date", "is_missing")))
    got = {r.limitation: r.detail for r in limitations.limitations(rated, e.run(rated), REGISTRY).collect()}
    assert set(got) == {"snapshot", "rating_order", "missing_values"} and got["snapshot"] == AS_OF.isoformat()
    ids = [r.product_id for r in e.run(QueryPlan("screen", ("listed_order",), AS_OF, top_k=1)).rows.collect()]
    out = [r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").where("o_orderstatus = 'P'").selectExpr("cast(o_orderkey as string)").limit(1).collect()]
    pair = QueryPlan("compare", ("listed_order",), AS_OF, filters=(Filter("product_id", "in", (ids[0], out[0])),), metrics=("total",), top_k=2)
    assert "comparison_incomplete" in {r.limitation for r in limitations.limitations(pair, e.run(pair), REGISTRY).collect()}
    said = spark.createDataFrame([("limitation", f"snapshot: {AS_OF.isoformat()}"), ("text", f"rating_order: {got['rating_order']}")], "kind string, value string")
    left = evidence.missing_limitations(limitations.limitations(rated, e.run(rated), REGISTRY), said)
    assert {r.limitation for r in left.collect()} == {"rating_order", "missing_values"}


def test_claims(spark):
    facts = spark.createDataFrame([("e1", "t", "p1", "f", "5", []), ("e2", "t", "p1", "g", "x", ["KRW"]), ("e3", "t", "p2", "f", "5", None)], "evidence_id string, product_type string, product_id string, field string, value string, groups array<string>")
    schema = "claim_id string, kind string, evidence_ids array<string>, product_type string, product_id string, field string, value string, groups array<string>"
    rows = [
        ("ok", "numeric", ["e1"], "t", "p1", "f", "5", None), ("ok2", "numeric", ["e3", "e1"], None, "p1", "f", "5", []), ("ok3", "text", ["e2"], "t", "p1", "g", "x", ["KRW"]), ("ok4", "candidate", ["e1", "e2"], "t", "p1", None, None, None), ("ok5", "text", [], None, None, None, "hello", None),
        ("bare", "numeric", [], "t", "p1", "f", "5", None), ("null", "numeric", None, "t", "p1", "f", "5", None), ("unknown", "text", ["e1", "e9"], None, None, None, None, None), ("value", "numeric", ["e1"], "t", "p1", "f", "6", None), ("product", "numeric", ["e1"], "t", "p2", "f", "5", None),
        ("groups", "numeric", ["e2"], "t", "p1", "g", "x", None), ("type", "numeric", ["e1"], "u", "p1", "f", "5", None), ("field", "text", ["e1"], "t", "p1", "g", "5", None), ("other", "candidate", ["e1", "e3"], "t", "p1", None, None, None), ("none", "candidate", [], "t", "p1", None, None, None),
    ]
    got = {r.claim_id: r.problem for r in evidence.claim_problems(spark.createDataFrame(rows, schema), facts).collect()}
    assert got == {
        "bare": "numeric claim without evidence", "null": "numeric claim without evidence", "unknown": "unknown evidence", "value": "differs from its evidence", "product": "differs from its evidence", "groups": "differs from its evidence",
        "type": "differs from its evidence", "field": "differs from its evidence", "other": "evidence of another product", "none": "evidence of another product"}


def test_packed_context_loses_nothing(spark):
    rows = [(i, f"t{i % 3}", "f", None if i % 2 else "s", "c", "d", f"e{i}", "bond", f"p{i}", f"x{i % 2}", "é" * (i % 5), "valid") for i in range(200)]
    df = spark.createDataFrame(rows, "at int, " + ", ".join(f"{c} string" for c in (*context.SOURCE, *context.PACKED))).repartition(4)
    for budget in (0, 1500, 10**6):
        c = context.packed_context(df, ["at"], budget)
        sources, kept, overflow = c.sources.collect(), c.kept.orderBy("so_far").collect(), c.overflow.collect()
        assert sorted(r.source_id for r in sources) == list(range(6))
        assert len(kept) + sum(r.n_rows for r in overflow) == 200 and all(r.so_far <= budget for r in kept)
        assert [r.evidence_id for r in kept] == [f"e{i}" for i in range(len(kept))]  # a prefix of the order
        key = {r.source_id: (r.source_table, r.source_sheet) for r in sources}
        assert all(key[r.source_id] == (f"t{int(r.evidence_id[1:]) % 3}", None if int(r.evidence_id[1:]) % 2 else "s") for r in kept)


def test_running_sums(spark):
    rows = [(i, None if i % 7 == 0 else i % 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    so_far, want = 0, {}
    for i, v in rows:
        so_far += v or 0
        want[i] = so_far
    got = ordering.running_sums(df, ["id"], "v")
    assert {r.id: r.so_far for r in got.collect()} == want and "SinglePartition" not in plan_of(got)


def test_bound_is_never_below_the_score(spark):
    rng = random.Random(9)
    pairs = [("".join(rng.choice("abcé 日.%\n") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abcé 日.%\n") for _ in range(rng.randint(0, 12)))) for _ in range(400)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", entities.score_bound(F.col("a"), F.col("b")).alias("bound")).collect()
    for r in got:
        shared = sum((Counter(r.a) & Counter(r.b)).values())
        assert r.bound == (20000 * shared // (len(r.a) + len(r.b)) if r.a or r.b else 10000)
        assert r.bound >= int(SequenceMatcher(None, r.a, r.b).ratio() * 10000)


def test_candidates_equal_the_plain_matcher(spark, monkeypatch):
    rng = random.Random(2)
    names = [("bond" if i % 3 else "fund", f"i{i:03d}", None if i == 5 else "".join(rng.choice("KODEX 200 미국 채권") for _ in range(rng.randint(0, 14)))) for i in range(500)]
    index = spark.createDataFrame(names, "product_type string, product_id string, name string").withColumn("other_id", F.lit(None).cast("string"))
    index = entities.entity_index([index])
    mentions = ["KODEX 200", "미국 채권 ETF", "zzz", ""]
    want = []
    for m in mentions:
        scored = [(int(SequenceMatcher(None, fold(m), fold(n)).ratio() * 10000), t, i) for t, i, n in names if n is not None]
        best = sorted((s for s in scored if s[0] >= 4000), key=lambda s: (-s[0], ["fund", "bond"].index(s[1]), s[2]))[:5]
        want += [(m, t, i, s, k) for k, (s, t, i) in enumerate(best, 1)]
    df = spark.createDataFrame([(m,) for m in mentions], "mention string")
    for first in (64, 6):
        monkeypatch.setattr(entities, "FIRST", first)
        got = entities.candidates(df, index, types=["fund", "bond"]).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    reach = entities.likely(entities.bounded(df, index, 4000), 5, 4000)
    print("share of pairs that reach the matcher:", reach.count() / (499 * len(mentions)))
    assert reach.count() < 0.5 * 499 * len(mentions) and "NestedLoop" not in plan_of(reach)
    with pytest.raises(ValueError):
        entities.candidates(spark.range(11).selectExpr("cast(id as string) as mention"), index)
    assert entities.candidates(df.limit(0), index).count() == 0


def test_source_files_against_a_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "CHUNK", 1000)
    sizes = {"a.xlsx": 0, "deep/b.xlsx": 2500, "c d.xlsx": 10, "wrong.xlsx": 10, "short.xlsx": 9, "more.xlsx": 1, "rows.xlsx": 5}
    (tmp_path / "deep").mkdir()
    manifest = []
    for n, k in sizes.items():
        (tmp_path / n).write_bytes(bytes(i % 251 for i in range(k)))
        manifest.append((n, k, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest().upper(), 3 if n == "rows.xlsx" else None, 2 if n == "rows.xlsx" else None))
    manifest = [m for m in manifest if m[0] != "more.xlsx"] + [("gone.xlsx", 1, "0", None, None)]
    (tmp_path / "wrong.xlsx").write_bytes(b"0" * 10)
    (tmp_path / "short.xlsx").write_bytes(b"0" * 8)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # contents that went through rows would fail
    try:
        digests = layers.file_digests(spark, str(tmp_path))
        files = layers.named_files(digests, f"file://{tmp_path}")
        m = spark.createDataFrame(manifest, "name string, size_bytes long, sha256 string, expected_rows long, expected_columns long")
        problems = lambda counts=None: {r.name: r.problem for r in layers.source_problems(files, m, counts).collect()}
        found = {"a.xlsx": "missing", "wrong.xlsx": "checksum differs", "short.xlsx": "size differs", "more.xlsx": "unexpected", "gone.xlsx": "missing"}
        assert problems() == found
        count = lambda r, c: spark.createDataFrame([("rows.xlsx", r, c)], "name string, n_rows long, n_columns long")
        assert problems(count(3, 2)) == found
        assert problems(count(4, 2)) == found | {"rows.xlsx": "row count differs"} and problems(count(3, 1)) == found | {"rows.xlsx": "column count differs"}
        assert problems(count(3, 2).limit(0)) == found | {"rows.xlsx": "not read"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_holding_counts_by_generation(spark):
    from tallyhouse.operators.holdings import holding_counts

    df = spark.createDataFrame([("g1", "t", "a"), ("g1", "t", "a"), ("g2", "t", "a")], "generation_id string, owner_type string, owner_id string")
    assert {tuple(r) for r in holding_counts(df).collect()} == {("g1", "t", "a", 2), ("g2", "t", "a", 1)}
    assert [tuple(r) for r in holding_counts(df.drop("generation_id")).collect()] == [("t", "a", 3)]
