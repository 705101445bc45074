"""Operator 11: Lloyd's centroids over distinct quantised vectors with multiplicities.

A kept vector's components become integers, floor(1024 * x). Identical integer
vectors are grouped once, with how many rows have them, and written; the
rounds read only these. In a round every task assigns its distinct vectors to
the nearest centroid and hands on, for every centroid and component, one
integer sum weighted by multiplicity; Spark adds these up, and the driver
takes centroids x components numbers, which does not grow with the data. At the end
the assignments are joined back to the rows by the vector's SHA-256. Vectors
that hold more than a thousandth of all rows, at most a thousand of them, are
broadcast for that join, so that no task takes all copies of one vector.

Defined cases: a null vector, one of another length and one with a null, NaN
or infinite component are left out; a null key counts as an empty text in the hash
that picks the starts, and stays null in the result; repeated keys are rows of
their own (equal hashes start by the vector's own order); equal distances go
to the smaller centroid; fewer vectors than centroids give fewer centroids; an
empty table gives no rows; other columns are ignored. A component beyond
+-2^27 counts as +-2^27, so that no distance leaves a long; a sum of distances
that would is the largest long.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

LENGTH, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Largest component: LENGTH * (2 * LARGEST)^2 stays below 2^63.
LARGEST = 1 << 27
#: A vector of more than this share of all rows, and of more than HEAVY rows, is joined by broadcast.
HEAVY_SHARE, HEAVY = 0.001, 100
#: Rows of a task that are compared with the centroids at once.
ROWS = 4096


def quantised(vectors: DataFrame, key: str, vector: str, length: int = LENGTH) -> DataFrame:
    """id, q (integers) and h (hexadecimal SHA-256 of q) of the rows whose vector has ``length`` finite components."""
    x = F.col("v")
    whole = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size(x) == length)
    whole = whole.where(~F.exists(x, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))))
    q = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))).cast("int"))
    return whole.select("id", q.alias("q")).withColumn("h", digest(F.col("q")))


def digest(q: Column) -> Column:
    return F.sha2(F.array_join(q.cast("array<string>"), ",").cast("binary"), 256)


def starts(kept: DataFrame, length: int = LENGTH, clusters: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """The vectors of the ``clusters`` smallest hashes of ``seed:key``, by hash; without any, the origin."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(rank.alias("rank"), "q").orderBy("rank", "q").limit(clusters).collect()
    return np.array([r["q"] for r in rows] or [[0] * length], np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest centroid for each row of ``q``; the smaller index of equals."""
    best, at = None, np.zeros(len(q), np.int32)
    for i, c in enumerate(centroids):
        d = ((q - c) ** 2).sum(1)
        if best is None:
            best = d
            continue
        near = d < best
        at[near] = i
        best = np.where(near, d, best)
    return at, best


def _rows(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over ``distinct`` (q, n): floor of the weighted means; empty ones stay."""
    length = centroids.shape[1]

    def run(batches):
        # exact in Python integers, whatever the multiplicities: a task adds few chunks to each sum
        sums = [[0] * length for _ in centroids]
        counts = [0] * len(centroids)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                q, n = _rows(batch, length), batch.column("n").to_numpy()
                at, _ = nearest(q, centroids)
                wide = int(n.max()) * LARGEST * len(n) >= 1 << 62
                for c in np.unique(at):
                    of = at == c
                    if wide:
                        more = (q[of].astype(object) * n[of].astype(object)[:, None]).sum(0)
                    else:
                        more = (q[of] * n[of][:, None]).sum(0)
                    sums[c] = [a + int(b) for a, b in zip(sums[c], more)]
                    counts[c] += sum(n[of].tolist()) if wide else int(n[of].sum())
        used = [c for c, k in enumerate(counts) if k]
        if used:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c for c in used for _ in range(length)], pa.int32()), pa.array([i for _ in used for i in range(length)], pa.int32()),
                    pa.array([Decimal(x) for c in used for x in sums[c]], pa.decimal128(38, 0)), pa.array([Decimal(counts[c]) for c in used for _ in range(length)], pa.decimal128(38, 0)),
                ],
                names=["cluster", "at", "total", "n"],
            )

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, at int, total decimal(38,0), n decimal(38,0)")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["at"]] = int(r["total"]) // int(r["n"])
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """h, n, cluster and distance of every row of ``distinct``."""
    length = centroids.shape[1]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                at, distance = nearest(_rows(batch, length), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("n"), pa.array(at), pa.array(distance)], names=["h", "n", "cluster", "distance"])

    return distinct.select("h", "n", "q").mapInArrow(run, "h string, n long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", length: int = LENGTH, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept row of ``vectors``."""
    spark = vectors.sparkSession
    kept = quantised(vectors, key, vector, length)
    distinct = written(kept.groupBy("h", "q").agg(F.count(F.lit(1)).alias("n")), "distinct")
    centroids = starts(kept, length, clusters, seed)
    for _ in range(rounds):
        after = moved(distinct, centroids)
        if (after == centroids).all():
            break  # later rounds would change nothing
        centroids = after
    last = written(assigned(distinct, centroids), "assigned")
    inertia = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n").cast("decimal(38,0)"))
    sums = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(inertia.cast("decimal(38,0)").alias("s")).collect()}
    text = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total, most = sum(sums.values(), 0), (1 << 63) - 1
    facts = spark.createDataFrame([(c, int(min(s, most)), int(min(total, most)), text[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    narrow, found = kept.select("id", "h"), last.select("h", "cluster", "distance")
    heavy = F.col("n") > max(HEAVY, HEAVY_SHARE * (last.agg(F.sum("n")).first()[0] or 0))
    if last.where(heavy).limit(1).count():
        few = F.broadcast(last.where(heavy).select("h", "cluster", "distance"))
        back = narrow.join(few, "h").unionByName(narrow.join(few.select("h"), "h", "left_anti").join(last.where(~heavy).select("h", "cluster", "distance"), "h"))
    else:
        back = narrow.join(found, "h")
    return back.join(F.broadcast(facts), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
