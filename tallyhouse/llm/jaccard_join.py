"""Operator 8: documents joined by the Jaccard similarity of their word five-grams.

Texts with equal sets of five-grams (lower-case words) form a class, which is
compared once. Classes get MinHash signatures; those that agree on a band of
values share a bucket. Members of a small bucket give candidate pairs. Buckets
with more members are joined to clusters (components), whose members are dealt
to blocks; a task compares two blocks and gives sums of links and a spanning
forest, never the pairs. A pair's MinHash values are compared in steps: after
each, the pair is dropped when the posterior probability (uniform prior) of
reaching the threshold is below the tolerance. What is left is verified exactly
on the whole sets. Links join classes to groups by connected components.

A pair at the threshold shares no band with probability under 2e-7, and is
dropped by the comparison with probability near the tolerance. The number of
links is exact, so a cluster of n different texts that are all alike takes n^2
comparisons, in blocks of bounded size; copies of one text count as one.
``SMALL`` and ``BROADCAST_KEYS`` choose a way to compute, never what is found.

Defined cases: a text of one to four words has one gram, all its words; a null
or empty text has none and is a group of its own, with no id of a copy; ids in
the result are the least non-null keys of a class and a group (null if all are
null); repeated rows are copies of each other; a very long text is one set of
grams in one task; an empty table gives no rows; other columns, whatever their
names, are ignored by the groups and kept by ``one_of_each_group``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import hash_words, keyed, lowered, mix, small_batches, token_chunks, written

GRAM, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS = 40, 5
STEP = 20
#: Words, and pairs of signatures, that a task works on at once.
CHUNK, PAIRS = 100_000, 16_384
#: Rows with signatures or sets of grams that a task takes out of a batch at once.
ROWS_AT_ONCE = 500
#: Members up to which a bucket gives pairs; documents of a block of larger ones.
SMALL, BLOCK = 32, 256

_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)


def grams(codes: np.ndarray, words: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """By text the sorted distinct hashes of its five-grams."""
    hashes = hash_words(words)[codes] if len(words) else np.zeros(0, np.uint64)
    rolling = hashes[:max(0, len(hashes) - GRAM + 1)]
    for k in range(1, GRAM):
        rolling = mix(rolling, hashes[k:k + len(rolling)])
    out, at = [], 0
    for n in lengths.tolist():
        if n >= GRAM:
            out.append(np.unique(rolling[at:at + n - GRAM + 1]))
        elif n:
            h = np.full(1, n, np.uint64)
            for k in range(n):
                h = mix(h, hashes[at + k:at + k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(own: np.ndarray) -> np.ndarray:
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 512):
            best = np.minimum(best, (low[i:i + 512, None] * MULTIPLY + ADD).min(axis=0))
    return best


def row_slices(batches):
    """The batches' rows, a few at a time, so that a batch's signatures or sets are copied in small parts."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def signatures(docs: DataFrame, key: str) -> DataFrame:
    """id, set (128-bit hash of the grams; null: none) and signature of each row."""
    def run(batches):
        for rows, codes, words, lengths in token_chunks(batches, lowered, most=CHUNK):
            found = grams(codes, words, lengths)
            yield from pa.table({"id": rows.column(key), "set": pa.array([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in found], pa.binary()), "signature": pa.array([signature(g).tobytes() if len(g) else None for g in found], pa.binary())}).to_batches()

    schema = docs.select(F.col(key).alias("id")).schema.add("set", "binary").add("signature", "binary")
    return docs.select(key, "text").mapInArrow(run, schema)


def bands(classes: DataFrame) -> DataFrame:
    """(cid, bucket) by class and band."""
    def run(batches):
        for b in row_slices(batches):
            x = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
            for k in range(ROWS):
                h = mix(h, x[:, :, k])
            n = x.shape[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("cid").to_numpy(), BANDS)), pa.array(h.reshape(n * BANDS).view(np.int64))], names=["cid", "bucket"])

    return classes.select("cid", "signature").mapInArrow(run, "cid long, bucket long")


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest agreeing values of so many at which the posterior, Beta(m + 1, n - m + 1), still gives the threshold its tolerance."""
    n, below = compared + 1, 0.0
    for m in range(n):
        below += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if below >= tolerance:  # P(similarity >= threshold) = P(Binomial(n + 1, threshold) <= m)
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which rows of two signature tables survive the comparison in steps."""
    alive, same = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, BANDS * ROWS, STEP):
        same[alive] += (a[alive, k:k + STEP] == b[alive, k:k + STEP]).sum(axis=1)
        alive = alive[same[alive] >= least_matches(k + STEP, threshold, tolerance)]
    return alive


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all xs with all ys, by products of incidence blocks over the grams that both sides have."""
    flat_x, flat_y = np.concatenate(xs), np.concatenate(ys)
    common = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(xs), len(ys)), np.float32)
    row_x, row_y = np.repeat(np.arange(len(xs)), [len(v) for v in xs]), np.repeat(np.arange(len(ys)), [len(v) for v in ys])
    at_x, at_y = np.searchsorted(common, flat_x), np.searchsorted(common, flat_y)
    in_x, in_y = np.isin(flat_x, common), np.isin(flat_y, common)
    for low in range(0, len(common), 4096):
        width = min(4096, len(common) - low)
        side = []
        for n, row, at, has in ((len(xs), row_x, at_x, in_x), (len(ys), row_y, at_y, in_y)):
            pick = has & (at >= low) & (at < low + width)
            m = np.zeros((n, width), np.float32)
            m[row[pick], at[pick] - low] = 1
            side.append(m)
        out += side[0] @ side[1].T
    return out


def compare_blocks(threshold: float, tolerance: float):
    """A task's two blocks of one cluster: links by class, and a spanning forest of them."""
    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        block = table.column("block").to_numpy()
        cid, times = table.column("cid").to_numpy(), table.column("times").to_numpy()
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        sets = [np.frombuffer(v, np.uint64) for v in table.column("grams").to_pylist()]
        left = np.flatnonzero(block == x)
        right = left if x == y else np.flatnonzero(block == y)
        links, copies = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64)
        first, second = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and len(right):
            same = np.zeros((len(left), len(right)), np.int32)
            for k in range(STEP):
                same += signs[left, k][:, None] == signs[right, k][None, :]
            i, j = np.nonzero(same >= least_matches(STEP, threshold, tolerance))
            if x == y:
                i, j = i[i < j], j[i < j]
            kept = [survivors(signs[left[i[p:p + PAIRS]]], signs[right[j[p:p + PAIRS]]], threshold, tolerance) + p for p in range(0, len(i), PAIRS)]
            kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            i, j = i[kept], j[kept]
            if len(i):
                ui, wi = np.unique(i, return_inverse=True)
                uj, wj = np.unique(j, return_inverse=True)
                both = overlaps([sets[k] for k in left[ui]], [sets[k] for k in right[uj]])[wi, wj]
                size = np.array([len(s) for s in sets])
                first, second = left[i], right[j]
                ok = both >= threshold * (size[first] + size[second] - both) - 1e-6
                first, second = first[ok], second[ok]
        for a, b in ((first, second), (second, first)):
            links += np.bincount(a, minlength=len(cid))
            copies += np.bincount(a, weights=times[b], minlength=len(cid)).astype(np.int64)
        root = np.arange(len(cid))
        if len(first):  # the least class that links reach, by label propagation in the block pair
            label = cid.copy()
            while True:
                low = label.copy()
                np.minimum.at(low, first, label[second])
                np.minimum.at(low, second, label[first])
                if (low == label).all():
                    break
                label = low
            root = label
        else:
            root = cid
        has = links > 0
        return pa.table({"cid": cid[has], "linked_to": root[has], "links": links[has], "copies": copies[has]})

    return run


def _grouped(docs: DataFrame, key: str, threshold: float, tolerance: float) -> DataFrame:
    """id, set, copy_id, component, group_id, times, links and copies of each row; the last six null without a set."""
    small_batches(docs.sparkSession)
    signed = written(signatures(docs, key), "signatures")
    classes = written(
        signed.where("set is not null").groupBy("set").agg(F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("times"), F.first("signature").alias("signature"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    links = _links(docs, classes, key, threshold, tolerance)
    group = components(links.select(F.col("cid").alias("a"), F.col("linked_to").alias("b")))
    sums = links.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    about = classes.select("cid", "set", "copy_id", "times").join(sums, "cid", "left").join(group.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = about.groupBy("component").agg(F.min("copy_id").alias("group_id"))
    about = about.join(named, "component").select(F.col("set").alias("of"), "copy_id", "component", "group_id", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(0)).alias("copies"))
    return signed.join(about, F.col("set") == F.col("of"), "left").drop("of", "signature")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """key, copy_id, group_id, n_linked_texts (different texts) and n_links (documents) of each row.

    copy_id: least key of the texts with equal grams; group_id: least key of
    all texts joined by links.
    """
    return _grouped(docs, key, threshold, tolerance).select(
        F.col("id").alias(key), "copy_id", F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_linked_texts"), F.coalesce(F.col("copies") + F.col("times") - 1, F.lit(0)).cast("bigint").alias("n_links"))


def _links(docs: DataFrame, classes: DataFrame, key: str, threshold: float, tolerance: float) -> DataFrame:
    """(cid, linked_to, links, copies): parts of each class's sums, and a class that it is joined to."""
    rows = written(bands(classes), "bands")
    # counted with map-side combining, so that a bucket of most classes is no burden to one task
    counted = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("least")).where("n > 1")
    members = written(rows.join(counted, "bucket"), "buckets")
    small = members.where(F.col("n") <= SMALL).select("bucket", "cid")
    pairs = small.join(small.select("bucket", F.col("cid").alias("other")), "bucket").where("cid < other").select("cid", "other").distinct()
    large = members.where(F.col("n") > SMALL)
    cluster = components(large.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    cluster = written(cluster, "clusters")
    # pairs within a cluster are compared there
    pairs = pairs.join(cluster.select(F.col("node").alias("cid"), F.col("component").alias("c")), "cid", "left").join(cluster.select(F.col("node").alias("other"), F.col("component").alias("o")), "other", "left").where("c is null or o is null or c != o").select("cid", "other")
    light = classes.select("cid", "signature")
    survive = pairs.join(light, "cid").join(light.select(F.col("cid").alias("other"), F.col("signature").alias("other_signature")), "other")

    def prune(batches):
        for b in row_slices(batches):
            a, o = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("signature", "other_signature"))
            yield b.select(["cid", "other"]).take(pa.array(survivors(a, o, threshold, tolerance)))

    pairs = written(survive.select("cid", "other", "signature", "other_signature").mapInArrow(prune, "cid long, other long"), "pairs")
    wanted = cluster.select(F.col("node").alias("cid")).unionByName(pairs.select("cid")).unionByName(pairs.select(F.col("other").alias("cid"))).distinct()
    whole = written(_gram_sets(docs, classes.join(wanted, "cid", "left_semi"), key), "grams")

    def verify(batches):
        for b in row_slices(batches):
            rows = []
            for cid, other, x, y, times, other_times in zip(*(b.column(c).to_pylist() for c in ("cid", "other", "grams", "other_grams", "times", "other_times"))):
                if similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold - 1e-9:
                    rows += [(cid, min(cid, other), 1, other_times), (other, min(cid, other), 1, times)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["cid", "linked_to", "links", "copies"])

    schema = "cid long, linked_to long, links long, copies long"
    of_pairs = pairs.join(whole.select("cid", "grams", "times"), "cid").join(whole.select(F.col("cid").alias("other"), F.col("grams").alias("other_grams"), F.col("times").alias("other_times")), "other").select("cid", "other", "grams", "other_grams", "times", "other_times").mapInArrow(verify, schema)

    sizes = cluster.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = cluster.join(sizes, "component").select("component", F.col("node").alias("cid"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    placed = placed.select("component", "cid", "block", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))
    of_clusters = placed.join(classes.select("cid", "signature"), "cid").join(whole.select("cid", "grams", "times"), "cid").select("component", "x", "y", "block", "cid", "times", "signature", "grams").groupBy("component", "x", "y").applyInArrow(compare_blocks(threshold, tolerance), schema)
    return written(of_pairs.unionByName(of_clusters), "links")


def _gram_sets(docs: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """cid, times and grams (packed hashes) of the given classes, from one whole text of each."""
    chosen = classes.select("cid", "times", "set", "copy_id")
    named = written(chosen.where("copy_id is not null").select(F.col("copy_id").alias(key)).distinct(), "wanted")
    # a class whose keys are all null is read by its set instead
    texts = keyed(docs.select(key, "text"), named, key, "left_semi")
    if not chosen.where("copy_id is null").isEmpty():
        texts = texts.unionByName(docs.where(F.col(key).isNull()).select(key, "text"))

    def run(batches):
        for _, codes, words, lengths in token_chunks(batches, lowered, most=CHUNK):
            found = [g for g in grams(codes, words, lengths) if len(g)]
            yield from pa.table({"set": pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in found], pa.binary()), "grams": pa.array([g.tobytes() for g in found], pa.binary())}).to_batches(max_chunksize=200)

    read = texts.mapInArrow(run, "set binary, grams binary").dropDuplicates(["set"])
    return read.join(chosen.select("cid", "times", "set"), "set").select("cid", "times", "grams")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group: the one with the least key, nulls last, and then the least hash of its grams; rows without words all stay.

    A row is known by its key and its grams. Keys that several rows share, and
    null keys, are told apart by the grams, so that no text goes because another
    one of its key does.
    """
    rows = written(_grouped(docs, key, threshold, TOLERANCE).select("id", "set", "component"), "groups")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "set")
    chosen = written(rows.where("set is not null").groupBy("component").agg(F.min(name).alias("row")).select("row.id", "row.set"), "chosen")
    again = written(rows.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "again")
    lost = rows.where("set is not null and id is not null").select("id", "set").join(chosen, ["id", "set"], "left_anti").select("id")
    apart = written(lost.unionByName(again).distinct().withColumnRenamed("id", key), "gone")
    kept = keyed(docs.where(F.col(key).isNotNull()), apart, key, "left_anti")
    named, unnamed = again.isEmpty(), rows.where("id is null").isEmpty()
    if named and unnamed:
        return kept
    hard = docs.where(F.col(key).isNull())
    if not named:
        hard = hard.unionByName(keyed(docs, again.withColumnRenamed("id", key), key, "left_semi"))

    def run(batches):
        for table, codes, words, lengths in token_chunks(batches, lowered, most=CHUNK):
            found = grams(codes, words, lengths)
            yield from pa.table({"row": table.column("row"), "own": table.column("own"), "own_set": pa.array([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in found], pa.binary())}).to_batches(max_chunksize=200)

    # the columns travel as one, so that no name can clash
    whole = hard.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(key).alias("own"), "text")
    told = written(whole.mapInArrow(run, whole.select("row", "own").schema.add("own_set", "binary")), "told")
    one = told.where("own_set is not null").dropDuplicates(["own", "own_set"]).join(chosen, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_set") == F.col("set")), "left_semi")
    return kept.unionByName(one.unionByName(told.where("own_set is null")).select("row.*"))
