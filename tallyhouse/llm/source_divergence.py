"""Operator 12: how far the sources of a language are apart, term by term, by systolic rotation.

Counting: a task counts the terms of a run of whole documents by group (lang,
source) and adds how many documents hold each, so one shuffle of
pre-aggregated counts gives counts and document frequencies. A language's kept terms
are dealt to slices of bounded size by hash and numbered by UTF-8 order within
their slice; a group's counts in a slice are packed into one row of numbers and counts.
Zero counts are not stored: they share one probability.

Rotation: the groups of a language are dealt to blocks of about ``BLOCK`` by hash.
In round r the packed rows of block (b + r) mod B travel to where block b
stays. Rounds 0 to B / 2 let every two blocks meet once, and each meeting
evaluates both directions. What stays is shuffled once, and every round reuses
that shuffle; a meeting holds two blocks of one slice, whatever the corpus. Distances
of slices add up. A group's terms above its language are ranked in each slice
by a local heap, and the heaps' tops merge.

Probabilities are exact integers: 1 + floor(10^9 * (count + 5) / (N + 5 V)).

Defined cases: a null text, lang or source counts as ''; a group without terms
takes part with counts of 0; a language without kept terms has values of 0; a language with
one source has no pairs; equal values rank by the item's UTF-8 bytes; repeated
rows count each; an empty table gives no rows; a text of any length is counted
whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import CHUNK_TOKENS, written

#: Documents of its language that a kept term stands in, at least.
LEAST_DOCS = 30
UNIT, SMOOTH, TOP = 1_000_000_000, 5, 50
#: Groups of a block, at most; few groups are dealt to blocks of about FEW, so that meetings run side by side. Kept terms of a slice. All are averages.
#: A meeting's memory is about 2 x BLOCK x SLICE x 8 bytes.
BLOCK, FEW, FEW_BLOCKS, SLICE = 128, 8, 8, 2048
#: Term bytes stay, in lower case; all others part terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term), summed within tasks only.

    Every group also has one row of the empty term, with n = 0, so that groups without terms stay.
    """
    def flush(tally):
        groups, words, n, d = [], [], [], []
        for group, (of, held) in tally.items():
            groups += [group] * (len(of) + 1)
            words += [b"", *of]
            n += [0, *of.values()]
            d += [0, *(held[w] for w in of)]
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    def run(batches):
        tally, seen = {}, 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i in range(batch.num_rows):
                found = terms(texts[i].as_py())
                of, held = tally.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                of.update(found)
                held.update(set(found))
                seen += len(found)
                if seen >= 2 * CHUNK_TOKENS:
                    yield flush(tally)
                    tally, seen = {}, 0
        if tally:
            yield flush(tally)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(run, COUNTS)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS, slice_terms: int = SLICE) -> DataFrame:
    """lang, term, slice, id (the term's place in its slice) and all_n (occurrences in the language) of the kept terms of ``counts``."""
    kept = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = written(kept, "terms")
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    dealt = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(max(1, -(-most // slice_terms)))).cast("int"))
    return written(dealt.withColumn("id", F.row_number().over(W.partitionBy("lang", "slice").orderBy("term")) - 1), "terms")


def probability(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exact for counts of any size."""
    below = max(total + SMOOTH * terms, 1)
    if len(count) and int(count.max()) >= (1 << 63) // UNIT - SMOOTH:
        return np.array([1 + UNIT * (int(c) + SMOOTH) // below for c in count], np.int64)
    return 1 + UNIT * (count + SMOOTH) // below


def packed(counts: DataFrame, numbered: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a (group, slice): its block of so many, total and number of kept terms, the slice's width, and ids, ns (its counts) and alls (the language's).

    A group without kept terms has empty lists; a language without any has one slice of width 0.
    """
    held = counts.where("term != ''").select("lang", "source", "term", "n").join(numbered, ["lang", "term"])
    entry = F.sort_array(F.collect_list(F.struct("id", "n", "all_n")))
    lists = written(held.groupBy("lang", "source", "slice").agg(entry.alias("x"), F.sum("n").alias("part")), "lists")
    slices = numbered.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("width"))
    languages = numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total"))
    groups = counts.where("term = ''").select("lang", "source")
    n = F.col("groups")
    blocks = F.greatest(F.ceil(n / block), F.least(F.lit(FEW_BLOCKS), F.ceil(n / min(FEW, block)))).cast("int")
    many = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).select("lang", blocks.alias("blocks"))
    totals = lists.groupBy("lang", "source").agg(F.sum("part").alias("total"))
    groups = groups.join(many, "lang").join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    rows = groups.join(slices, "lang", "left").na.fill(0, ["total", "terms", "all_total", "slice", "width"]).join(lists.drop("part"), ["lang", "source", "slice"], "left")
    ids, ns, alls = (F.coalesce(F.col(f"x.{c}"), F.array().cast(f"array<{t}>")).alias(a) for c, a, t in (("id", "ids", "int"), ("n", "ns", "long"), ("all_n", "alls", "long")))
    at = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    return rows.select("lang", "source", "slice", "blocks", at, "total", "terms", "all_total", F.col("width").cast("int").alias("width"), ids, ns, alls)


def _lists(table: pa.Table | pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.fromiter((len(x) for x in column), np.int64, len(column)))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _vectors(table: pa.Table) -> list[tuple[str, np.ndarray]]:
    """Each group's probabilities of all terms of the slice."""
    out = []
    plain = [table.column(c).to_pylist() for c in ("source", "width", "total", "terms")]
    for source, width, total, terms, ids, ns in zip(*plain, _lists(table, "ids"), _lists(table, "ns")):
        n = np.zeros(width, np.int64)
        n[ids] = ns
        out.append((source, probability(n, total, terms)))
    return out


def meeting(stay: pa.Table, came: pa.Table) -> pa.Table:
    """Distances of every two groups of two blocks (of a block and itself: each two once) in one slice, in both directions."""
    source, item, value = [], [], []
    if stay.num_rows and came.num_rows:
        mine = _vectors(stay)
        same = stay.column("block")[0] == came.column("block")[0]
        theirs = mine if same else _vectors(came)
        for i, (x, p) in enumerate(mine):
            for y, q in theirs[i + 1:] if same else theirs:
                d = int(np.abs(p - q).sum())
                source += [x, y]
                item += [y, x]
                value += [d, d]
    lang = [stay.column("lang")[0].as_py()] * len(source) if source else []
    return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def rotated(rows: DataFrame, blocks: int) -> DataFrame:
    """lang, source, item, value of every meeting of ``rows``; blocks: those of the language with most."""
    rows = rows.drop("all_total", "alls")
    stay, met = rows.groupBy("lang", "slice", "block"), []
    for r in range(blocks // 2 + 1):
        came = rows.withColumn("host", F.pmod(F.col("block") - r, F.col("blocks")))
        # a language of fewer blocks has ended its tournament; of an even number, the last round's meetings are held at one of the two hosts
        on = (F.col("blocks") > 2 * r) | ((F.col("blocks") == 2 * r) & (F.col("host") < r))
        met.append(stay.cogroup(came.where(on).groupBy("lang", "slice", "host")).applyInArrow(meeting, "lang string, source string, item string, value long"))
    out = met[0]
    for x in met[1:]:
        out = out.unionByName(x)
    return out


def leading(rows: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, slice, id, value: a group's leading terms above its language in each slice, by local heaps."""
    def run(batches):
        for batch in batches:
            at, ids, value = [], [], []
            plain = [batch.column(c).to_pylist() for c in ("total", "all_total", "terms")]
            for i, (total, all_total, terms, held, n, all_n) in enumerate(zip(*plain, _lists(batch, "ids"), _lists(batch, "ns"), _lists(batch, "alls"))):
                more = probability(n, total, terms) - probability(all_n, all_total, terms)
                best = heapq.nsmallest(top, ((-int(more[j]), int(held[j])) for j in np.flatnonzero(more > 0)))
                at += [i] * len(best)
                ids += [j for _, j in best]
                value += [-f for f, _ in best]
            names = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("lang", "source", "slice")]
            yield pa.RecordBatch.from_arrays([*names, pa.array(ids, pa.int32()), pa.array(value, pa.int64())], names=["lang", "source", "slice", "id", "value"])

    held = rows.where(F.size("ids") > 0).select("lang", "source", "slice", "total", "all_total", "terms", "ids", "ns", "alls")
    return held.mapInArrow(run, "lang string, source string, slice int, id int, value long")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, slice_terms: int = SLICE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank of every group of ``docs``."""
    counts = written(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    numbered = kept_terms(counts, least, slice_terms)
    rows = written(packed(counts, numbered, block), "packed")
    pairs = rotated(rows, rows.agg(F.max("blocks")).first()[0] or 0).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    tops = leading(rows, top).join(numbered.select("lang", "slice", "id", F.col("term").alias("item")), ["lang", "slice", "id"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return pairs.unionByName(tops.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top))
