"""The mix against its targets, and its defined cases."""

import random
from collections import defaultdict

import pytest

from tallyhouse.llm import mixing
from tallyhouse.llm.mixing import mix


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / w for s in names}
        more = {s for s in names if target[s] > 3 * sizes[s]}
        if not more - full:
            return target
        full |= more


@pytest.mark.parametrize("block", [4096, 16])
def test_mix(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    random.seed(7)
    rows = [(i, random.choice(["a", "b", "B", "é", None, "tiny"] if i % 50 == 0 else ["a", "a", "b", "é", None]), "w " * random.randint(0, 40), i) for i in range(1500)]
    rows += [(0, rows[0][1], rows[0][2], 1)] * 3 + [(None, "a", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, taken int").repartition(4)
    got = mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(45, 0.02 * t), s


def test_edge_cases(spark):
    schema = "doc_id long, source string, text string"
    assert mix(spark.createDataFrame([], schema)).collect() == []
    got = mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_columns_of_any_name_stay(spark):
    from tallyhouse.llm.mixing import ADDED, mixed_documents

    rows = [(i, "abc"[i % 3], "w " * (i % 40 + 1), i, -i, str(i), i, "m") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, k int, s int, z string, size int, mix string")
    out = mixed_documents(df)
    assert out.columns == [*(c for c in df.columns if c not in ADDED), *ADDED]
    got = out.collect()
    assert got and all((r.k, r.s, r.z, r.mix, r.size) == (r.doc_id, -r.doc_id, str(r.doc_id), "m", r.doc_id % 40 + 1) for r in got)
    assert mixed_documents(df.limit(0)).collect() == []
