"""Centroid clustering against Lloyd's rounds in plain Python, and its defined cases."""

import hashlib
import math
import random

import pytest

from tallyhouse.llm import centroid_clustering
from tallyhouse.llm.centroid_clustering import centroid_clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, q int"


def brute(rows, length, clusters=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(1024 * x))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for k in range(len(centroids)):
            of = [q for (_, q), (_, c) in zip(kept, at) if c == k]
            if of:
                centroids[k] = [sum(x) // len(of) for x in zip(*of)]
    at = assign()
    inertia = [sum(d for d, c in at if c == k) for k in range(len(centroids))]
    most = (1 << 63) - 1
    return sorted((str(i), c, d, min(most, inertia[c]), min(most, sum(inertia)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at))


def result(df, **more):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroid_clusters(df, **more).collect())


@pytest.mark.parametrize("copies", [0, 400])
def test_against_plain_rounds(spark, copies, monkeypatch):
    monkeypatch.setattr(centroid_clustering, "ROWS", 7)
    monkeypatch.setattr(centroid_clustering, "HEAVY", 50)
    random.seed(copies)
    f = lambda x: float(f"{x:.3f}") * 0.5
    import numpy as np

    rows = [(i, [float(np.float32(f(random.gauss(i % 3, 1)))) for _ in range(6)]) for i in range(120)]
    rows += [(1000 + i, rows[5][1]) for i in range(copies)]  # a hot group of identical vectors
    rows += [(2000 + i, [0.0] * 6) for i in range(20)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(3000, None), (3001, [1.0] * 5), (3002, [1.0] * 7), (3003, [1.0, None] * 3), (3004, [float("nan")] * 6), (3005, [float("inf")] + [0.0] * 5), (3006, [])]
    rows += [(4000, [3e38, -3e38, 0.0, 0.0, 0.0, 0.0])]  # far beyond a long
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert result(df, length=6) == brute(rows, 6)


def test_ties_and_few_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0])]
    assert result(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), length=2) == brute(rows, 2)
    rows = [(1, [0.5, 0.5])] * 12  # all starts are equal: the first takes all, the others stay empty
    got = result(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), length=2)
    assert got == brute(rows, 2) and {r[1] for r in got} == {0}


def test_empty_table(spark):
    assert centroid_clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroid_clusters(spark.createDataFrame([(1, [1.0], "x", 1)], SCHEMA)).collect() == []


def test_double_vectors(spark):
    rows = [(i, [i * 0.1, 1e300 if i == 3 else -i * 0.3]) for i in range(30)]
    assert result(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), length=2) == brute(rows, 2)
