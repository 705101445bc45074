"""Operator 6: mixing sources to target weights by balanced sampling (cube method).

A source whose target is r times its size takes each document floor(r) times,
and once more with probability r - floor(r). The cube method decides who is
taken once more: within a block of documents of one source it moves the
fractional probabilities along directions that leave the taken words and the
taken documents unchanged, until at most two of the block stay fractional.
Those of all blocks form new blocks, and so on until a source fits into one
block; there the rest lands by dropping the constraint on documents, then the
one on words, and at most eight decisions of that block turn round to undo the
error in words that a long document's landing leaves. Blocks are dealt by hash, so that a source with most rows is
spread over many tasks; every random number comes from the block's own seed,
so that reruns agree.

Defined cases: a null source is a source of its own, last in order; a null or
empty text has size 0; rows that agree in key, source and size share one
decision; a source without words takes nothing; an empty table gives no rows;
other columns are kept out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import positions
from .shared import n_words, written

MOST_TIMES = 3
WEIGHTS = (1, 2, 3)
#: Columns that ``mixed_documents`` adds.
ADDED = ("size", "source_size", "target", "taken")
#: Documents of a block, on average.
BLOCK = 4096


def flight(p: np.ndarray, size: np.ndarray, weight: np.ndarray, rng: np.random.Generator, constraints: int = 2) -> np.ndarray:
    """Move probabilities ``p`` so that sum(p*size) and, with two constraints, sum(p*weight) stay, until no direction is left."""
    p, eps = p.copy(), 1e-9
    scale = max(float(size.max(initial=0)), 1.0)
    rows = [size / scale, weight / max(float(weight.max(initial=0)), 1.0)][:constraints]
    wait = list(np.flatnonzero((p > eps) & (p < 1 - eps))[::-1])
    held: list[int] = []
    while True:
        while wait and len(held) < constraints + 1:
            held.append(wait.pop())
        if len(held) < constraints + 1:
            break
        a = rows[0][held]
        if constraints == 1:
            u = np.array([a[1], -a[0]]) if a.any() else np.array([1.0, -1.0])
        else:
            b = rows[1][held]
            u = np.cross(a, b)
            if np.abs(u).max() < 1e-12:  # one constraint is a multiple of the other here
                c = a if a.any() else b
                i, j = (0, 1) if c[0] or c[1] else (0, 2)
                u = np.zeros(3)
                u[i], u[j] = (c[j], -c[i]) if c[i] or c[j] else (1.0, -1.0)
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        p[held] = np.where(q < eps, 0.0, np.where(q > 1 - eps, 1.0, q))
        held = [i for i in held if eps < p[i] < 1 - eps]
    return p


def landing(p: np.ndarray, size: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    p = flight(p, size, weight, rng, 1)
    left = (p > 0) & (p < 1)
    p[left] = rng.random(int(left.sum())) < p[left]
    return p


def repair(before: np.ndarray, taken: np.ndarray, size: np.ndarray, flips: int = 8) -> np.ndarray:
    """Turn single decisions of the last block round while that brings its words nearer to what the probabilities ask for."""
    free, taken = (before > 1e-9) & (before < 1 - 1e-9), taken.copy()
    for _ in range(flips):
        error = float((size * (taken - before)).sum())
        after = np.where(free, np.abs(error + np.where(taken > 0.5, -size, size)), np.inf)
        best = int(np.argmin(after)) if len(after) else -1
        if best < 0 or after[best] >= abs(error) - 1e-6:
            break
        taken[best] = 1 - taken[best]
    return taken


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target of a table (source, size); one row a source.

    Weights 1, 2, 3, 1, ... go by the sources' code points, null last. A
    target above three times its source's size stops there; the excess is
    shared again by weight until none is above.
    """
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = positions(totals, [F.col("source").asc_nulls_last()], "at")
    ranked = written(ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("at") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")), "sources")
    cap = F.col("source_size") * MOST_TIMES
    level, capped = 0.0, -1
    while True:
        over = F.col("w") * level > cap
        x = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, cap)).alias("full"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if x["n"] == capped or not x["all"] or not x["w"]:
            break
        capped, level = x["n"], (x["all"] - (x["full"] or 0)) / x["w"]
    return ranked.select("source", "n_docs", "source_size", F.least(F.col("w") * level, cap.cast("double")).alias("target"))


def fly(seed: int, level: int, last: bool):
    """The flight of one block; where it is a source's last block, the landing too."""
    def run(key, pdf):
        rng = np.random.default_rng(xxhash.xxh3_64_intdigest(repr((seed, level, key[0], int(key[1]))).encode()))
        order = pdf["id"].map(lambda x: xxhash.xxh3_64_intdigest(repr((x, level)).encode()))
        pdf = pdf.assign(at=order).sort_values(["at", "size", "times"], kind="stable").drop(columns=["at", "block"])
        size, weight = (pdf["size"] * pdf["times"]).to_numpy(float), pdf["times"].to_numpy(float)
        before = pdf["p"].to_numpy(float)
        p = flight(before, size, weight, rng)
        if last:
            p = repair(before, landing(p, size, weight, rng), size)
        return pdf.assign(p=p, level=np.int32(level))

    return run


def decide(units: DataFrame, n_largest: int, seed: int) -> DataFrame:
    """``units`` (id, source, size, times, p, n_source) with p moved to 0 or 1. n_largest: units of the largest source."""
    schema = units.select("id", "source", "size", "times", "p").schema.add("level", "integer")
    level, decided = 0, []
    while True:
        blocks = max(1, math.ceil(n_largest / BLOCK))
        last = blocks == 1

        # as many blocks for every source as its own rows ask for
        own = F.greatest(F.lit(1), F.ceil(F.col("n_source") / BLOCK)) if level == 0 else F.lit(blocks)
        block = F.pmod(F.xxhash64("id", "size", F.lit(level)), own).alias("block")
        dealt = units.withColumn("block", block)
        moved = written(dealt.select("id", "source", "size", "times", "p", "block").groupBy("source", "block").applyInPandas(fly(seed, level, last), schema), "cube")
        left = F.col("p").between(1e-9, 1 - 1e-9)
        decided.append(moved.where(~left))
        if last:
            break
        units, level = moved.where(left).drop("level"), level + 1
        n_largest = (units.groupBy("source").count().agg(F.max("count")).first()[0]) or 0
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return out


def _decisions(narrow: DataFrame, seed: int) -> DataFrame:
    """Of a written table (id, source, size): mix (key, source and size), source_size, target and taken of each distinct row."""
    targets = written(source_targets(narrow.select("source", "size")), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_TIMES)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(1e-9))
    goals = targets.select(F.col("source").alias("of"), "n_docs", "source_size", "target", whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("part"))
    units = narrow.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    units = units.join(goals.select("of", F.col("n_docs").alias("n_source"), F.col("part").alias("p")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    n_largest = targets.agg(F.max("n_docs")).first()[0] or 0
    more = decide(units, n_largest, seed).join(goals, F.col("source").eqNullSafe(F.col("of")))
    return more.select(F.struct(F.col("id").alias("key"), "source", "size").alias("mix"), "source_size", "target", (F.col("size") * (F.col("whole") + F.col("p").cast("long"))).alias("taken"))


def _same(key: str):
    return F.col(key).eqNullSafe(F.col("mix.key")) & F.col("source").eqNullSafe(F.col("mix.source")) & F.col("size").eqNullSafe(F.col("mix.size"))


def _narrow(docs: DataFrame, key: str) -> DataFrame:
    return written(docs.select(F.col(key).alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "mix")


def mix(docs: DataFrame, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """key, source, size, source_size, target (of the source) and taken (words) of each row of ``docs``."""
    narrow = _narrow(docs, key)
    return narrow.join(_decisions(narrow, seed), _same("id")).select(F.col("id").alias(key), "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target and taken; columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ADDED]
    # the text's columns travel as one, so that no name of theirs can clash
    whole = docs.select(F.struct(*own).alias("row"), F.col(key).alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    mixed = whole.join(_decisions(_narrow(docs, key), seed), _same("id")).where("taken > 0")
    return mixed.select("row.*", *(F.col(c).alias(c) for c in ADDED))
