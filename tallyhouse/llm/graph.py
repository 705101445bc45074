"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: A node is heavy if it has more than this share of all edges, and this many; so that heavy nodes are few.
HEAVY_SHARE, HEAVY = 0.001, 100


def _stars(edges: DataFrame, large: bool, heavy: float) -> DataFrame:
    """Each node's larger (or smaller) neighbours tied to the least node of its neighbourhood.

    heavy: edges from which a node is heavy. Its edges stay where they are and
    its least neighbour goes to them, so that no task takes them all; heavy
    nodes are at most 2 / HEAVY_SHARE, so that side is safe to broadcast.
    """
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"), "n")
    few = F.broadcast(least.where(F.col("n") > heavy))
    same = F.col("a") == F.col("c")
    tied = both.join(few, same).unionByName(both.join(few, same, "left_anti").join(least.where(F.col("n") <= heavy), same))
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``edges`` (a, b: bigint).

    Every round is written to the shared folder. It ends when a round changes
    nothing, after a number of rounds that grows with the logarithm of the
    longest path.
    """
    edges, before = written(edges.where("a != b").select("a", "b").distinct(), "edges"), None
    heavy = max(HEAVY, HEAVY_SHARE * edges.count())
    while True:
        edges = written(_stars(written(_stars(edges, True, heavy), "edges"), False, heavy), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
