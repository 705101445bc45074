"""Operator 1: passages that repeat across documents, by compact windows.

A document is a sequence of word five-grams (lower case). For each of a few
hash functions, the Cartesian tree over the grams' hashes groups its
subsequences by where their least hash stands: the node at position c with
extent [l, r] is a compact window, whose hash is the MinHash of every
subsequence of [l, r] that holds c. Only nodes whose extent reaches the
shortest passage matter; they are the positions that are least in some run of
that length, found with sliding minima, about two a passage length and hash.
A window carries the first and the last run of which it is least, so that
extents are known, to a run's length on either side, without the text.

Windows with one hash, of one function, share a bucket. Rows grow with a
bucket's members and not with their pairs: each is tied to the first one that
has the same gram ``FAR`` places before, to the first with the same gram
``FAR`` places after, and, unless both are earlier ones, to the bucket's first.
Of a passage that stands in two documents unchanged, at least one of these
grams is always inside, so that other documents which share only a frequent
line with both cannot come between them. Two documents tied under enough
functions are joined on intervals: stretches that extents of enough functions
cover on both sides, and that reach a run, are cut out and verified. A verified
passage has the shortest length at least, and its grams on both sides reach
the threshold in Jaccard similarity.

Hot buckets: where a chunk holds many of a bucket, they meet in a bucket of
their own, and only the first of each context also goes to the shared one. A
bucket that stands in a hundredth of all documents, by an exact count, is dealt
by context everywhere, so that a frequent line does not fill one task. Neither
drops a window.

Defined cases: texts shorter than a passage, empty and null ones have none;
rows that agree in key and text count as one document, and repeats within a
document are not reported; a null key is reported as null; an empty table
gives no rows; other columns, whatever their names, are ignored; a very long
text is cut into slices around its candidate stretches. Documents are told
apart by 64 bits of key and text, words by 32 bits, five of them in a row
wherever grams are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hash_words, keyed, lowered, mix, token_chunks, written

GRAM, LEAST_WORDS, THRESHOLD = 5, 50, 0.8
FUNCTIONS, ENOUGH = 5, 2
#: Words that a task works on at once.
CHUNK = 400_000
#: Members of a bucket within a chunk from which they meet in a bucket of their own.
CROWD = 16
#: Distance of the grams that are a window's contexts; under half a passage.
FAR = 22
#: The share of all rows from which a bucket is hot; in a table of under SAMPLE rows, the share of so many.
SAMPLE, HOT = 4_000, 0.01
#: Grams that edits may leave unmatched in a row; how far edits may shift a passage.
GAP, SHIFT = 16, 16

_rng = np.random.default_rng(10)
MULTIPLY = _rng.integers(0, 1 << 32, FUNCTIONS, np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, FUNCTIONS, np.uint64).astype(np.uint32)


def rolling(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all five-grams of words' 32-bit hashes."""
    words = hashes.astype(np.uint64)
    out = words[:max(0, len(words) - GRAM + 1)]
    for k in range(1, GRAM):
        out = mix(out, words[k:k + len(out)])
    return out


def word_hashes(codes: np.ndarray, words: list[bytes]) -> np.ndarray:
    return hash_words(words).astype(np.uint32)[codes]


def gram_hashes(codes: np.ndarray, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-grams of the texts, one after another, and how many each text has."""
    n = np.maximum(lengths - GRAM + 1, 0)
    if len(codes) < GRAM:
        return np.zeros(0, np.uint64), n * 0
    grams = rolling(word_hashes(codes, words))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return grams[doc[:len(grams)] == doc[GRAM - 1:]], n


def values(grams: np.ndarray, k: int) -> np.ndarray:
    """The k-th function's 32-bit hash of grams, as uint64."""
    with np.errstate(over="ignore"):
        low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32) * MULTIPLY[k] + ADD[k]
    return (low ^ (low >> np.uint32(15))).astype(np.uint64)


def run_minima(hashed: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The position that is least, leftmost of equals, in each run of so many grams of one document; the runs' starts."""
    n = len(hashed)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = (hashed << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // run) * run, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, run)
    forth = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[:n - run + 1], forth[run - 1:n])
    starts = np.flatnonzero(doc[:n - run + 1] == doc[run - 1:])
    return (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), starts


def anchors(hashed: np.ndarray, doc: np.ndarray, run: int) -> np.ndarray:
    """Positions that are least in a run."""
    return np.unique(run_minima(hashed, doc, run)[0])


def crowds(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Members of a bucket that is crowded in this chunk get one of their own; the first of each context is repeated in the shared one."""
    bucket = columns["bucket"]
    which, times = np.unique(bucket, return_inverse=True, return_counts=True)[1:]
    many = times[which] >= CROWD
    if not many.any():
        return columns
    outside, own = [], bucket.copy()
    at = np.flatnonzero(many)
    for side in ("before", "after"):
        order = at[np.lexsort((columns["place"][at], columns["rid"][at], columns[side][at], which[at]))]
        heads = np.append(True, (np.diff(which[order]) != 0) | (np.diff(columns[side][order]) != 0))
        outside.append(order[heads])
    firsts = order[np.append(True, np.diff(which[order]) != 0)]
    apart = np.zeros(len(times), np.uint64)
    apart[which[firsts]] = mix(mix(bucket[firsts].view(np.uint64), columns["rid"][firsts].view(np.uint64)), columns["place"][firsts].view(np.uint64))
    own[at] = apart[which[at]].view(np.int64)
    outside = np.unique(np.concatenate(outside))
    return {k: np.append(own if k == "bucket" else x, x[outside]) for k, x in columns.items()}


def by_context(columns: dict[str, np.ndarray], hot: np.ndarray) -> dict[str, np.ndarray]:
    """Members of a hot bucket go to two buckets that hold one context each."""
    is_hot = np.isin(columns["bucket"], hot)
    if not is_hot.any():
        return columns
    parts = [{k: x[~is_hot] for k, x in columns.items()}]
    for side, salt in (("before", 1), ("after", 2)):
        one = {k: x[is_hot] for k, x in columns.items()}
        context = one[side].astype(np.int64).view(np.uint64)
        parts.append(one | {"bucket": mix(mix(one["bucket"].view(np.uint64), context), np.uint64(salt)).view(np.int64), "before": one["before"] * 0, "after": one["after"] * 0})
    return {k: np.concatenate([x[k] for x in parts]) for k in columns}


def windows_of(rid: np.ndarray, codes: np.ndarray, words: list[bytes], lengths: np.ndarray, run: int) -> dict[str, np.ndarray]:
    """Windows of a chunk; the low bits of place say how far before it the first and the last run start of which it is least."""
    bits = run.bit_length()
    grams, n = gram_hashes(codes, words, lengths)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.cumsum(n) - n
    short = (grams >> np.uint64(33)).astype(np.int32)
    parts = []
    for k in range(FUNCTIONS):
        least, starts = run_minima(values(grams, k), doc, run)
        at, head, times = np.unique(least, return_index=True, return_counts=True)
        back, ahead = at - starts[head], at - starts[head + times - 1]
        own = doc[at]
        # beyond the text's ends the first and the last gram stand for the context
        before, after = short[np.maximum(at - FAR, start[own])], short[np.minimum(at + FAR, start[own] + n[own] - 1)]
        place = (((at - start[own]) * FUNCTIONS + k) << 2 * bits) | back << bits | ahead
        parts.append({"bucket": mix(grams[at], np.uint64(k)).view(np.int64), "rid": rid[own], "place": place, "before": before, "after": after})
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def window_rows(run: int, hot: np.ndarray):
    def work(batches):
        for rows, codes, words, lengths in token_chunks(batches, lowered, most=CHUNK):
            found = windows_of(rows.column("rid").to_numpy(), codes, words, lengths, run)
            yield from pa.table(crowds(by_context(found, hot))).to_batches(max_chunksize=50_000)
    return work


def bucket_counts(run: int, of: np.ndarray | None = None):
    """A task's (bucket, n): in how many of its rows a bucket is, less what is taken off; of: the only buckets to count, whole.

    Half of HOT of the rows so far is taken off all counts (lossy counting), so that a task keeps few of its buckets.
    """
    def work(batches):
        known, n, rows_so_far, off = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        for rows, codes, words, lengths in token_chunks(batches, lowered, most=CHUNK):
            found = windows_of(np.arange(len(lengths)), codes, words, lengths, run)
            here = slice(None) if of is None else np.isin(found["bucket"], of)
            bucket, row = found["bucket"][here], found["rid"][here]
            order = np.lexsort((row, bucket))
            bucket, row = bucket[order], row[order]
            pairs = bucket[1:][(bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])]
            pairs = np.append(bucket[:1], pairs)
            known, which = np.unique(np.append(known, pairs), return_inverse=True)
            n = np.bincount(which, weights=np.append(n, np.ones(len(pairs))), minlength=len(known)).astype(np.int64)
            rows_so_far += len(lengths)
            if of is None and (more := int(HOT / 2 * rows_so_far) - off):
                off += more
                n = n - more
                known, n = known[n > 0], n[n > 0]
        yield from pa.table({"bucket": known, "n": n}).to_batches(max_chunksize=50_000)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([None], pa.int64()), "n": [off]})  # the null bucket's n is what was taken off
    return work


def hot_buckets(base: DataFrame, run: int) -> np.ndarray:
    """Buckets that are in a hundredth of all rows, or of SAMPLE where there are fewer; under 100 times the windows of a document, however many documents there are.

    All rows are counted twice: the first time gives a few more buckets than
    there are hot ones but misses none, the second their exact numbers.
    """
    texts = base.select("text")
    least = HOT * max(SAMPLE, base.count())
    counted = written(texts.mapInArrow(bucket_counts(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "bucket-counts")
    off = counted.where("bucket is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    likely = np.array(sorted(r["bucket"] for r in counted.where(F.col("bucket").isNotNull() & (F.col("n") + off >= least)).select("bucket").collect()), np.int64)
    if not len(likely):
        return likely
    exact = texts.mapInArrow(bucket_counts(run, likely), "bucket long, n long").where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["bucket"] for r in exact.where(F.col("n") >= least).select("bucket").collect()), np.int64)


def ties(windows: DataFrame) -> DataFrame:
    """(low, high, low_place, high_place): two documents and their windows of one hash; low is the lesser id."""
    me = F.struct("rid", "place")
    in_bucket = W.partitionBy("bucket").orderBy("before", "rid", "place")
    so_far = (W.unboundedPreceding, W.currentRow)

    def first(side):
        return F.first(me).over(W.partitionBy("bucket", side).orderBy("rid", "place").rowsBetween(*so_far))

    rows = windows.withColumns({"first": F.first(me).over(in_bucket.rowsBetween(*so_far)), "by_before": first("before"), "shared": F.lag("rid").over(in_bucket).isNotNull() | F.lead("rid").over(in_bucket).isNotNull()})
    rows = rows.where("shared").select("rid", "place", "first", "by_before", first("after").alias("by_after"))
    alone = (F.col("by_before") == me) | (F.col("by_after") == me)
    rows = rows.select("rid", "place", F.explode(F.array_distinct(F.array("by_before", "by_after", F.when(alone, F.col("first")).otherwise(F.col("by_before"))))).alias("hub")).where("hub.rid != rid")
    swap = F.col("hub.rid") > F.col("rid")
    return rows.select(
        F.when(swap, F.col("rid")).otherwise(F.col("hub.rid")).alias("low"), F.when(swap, F.col("hub.rid")).otherwise(F.col("rid")).alias("high"),
        F.when(swap, F.col("place")).otherwise(F.col("hub.place")).alias("low_place"), F.when(swap, F.col("hub.place")).otherwise(F.col("place")).alias("high_place"))


def extents(places: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position and function of windows, and [l, r]: the union of the runs of which each is least."""
    bits = run.bit_length()
    mask = (1 << bits) - 1
    c, k = np.divmod(places >> 2 * bits, FUNCTIONS)
    return c, k, np.stack([c - (places >> bits & mask), c - (places & mask) + run - 1], axis=1)


def covered(windows: np.ndarray, kinds: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Stretches covered by windows of at least so many kinds (a sweep over their ends)."""
    events = sorted([(int(l), 1, int(k)) for (l, _), k in zip(windows, kinds)] + [(int(r) + 1, 0, int(k)) for (_, r), k in zip(windows, kinds)])
    open_, out, since = {}, [], None
    for at, opening, k in events:  # at one place, ends come before starts
        if not opening:
            open_[k] -= 1
            if not open_[k]:
                del open_[k]
                if since is not None and len(open_) < need:
                    out.append((since, at - 1))
                    since = None
        else:
            open_[k] = open_.get(k, 0) + 1
            if since is None and len(open_) >= need:
                since = at
    return out


def stretches(theirs: np.ndarray, mine: np.ndarray, run: int) -> list[tuple[int, int, int, int, int]]:
    """(first, last, their first, their last, shift) in grams, where extents of enough functions cover a run on both sides.

    theirs, mine: places of windows of one hash, in two documents.
    """
    c, kinds, windows = extents(mine, run)
    other, _, their_windows = extents(theirs, run)
    shift = c - other
    order = np.argsort(shift, kind="stable")
    out = []
    for group in np.split(order, np.flatnonzero(np.diff(shift[order]) > SHIFT) + 1):
        if len(set(kinds[group].tolist())) < ENOUGH:
            continue
        d = int(np.median(shift[group]))
        own, far = windows[group], their_windows[group]
        for s, e in covered(own, kinds[group], ENOUGH):
            if e - s + 1 < run:
                continue
            inside = (own[:, 0] <= e) & (own[:, 1] >= s)
            a, b = int(far[inside, 0].min()), int(far[inside, 1].max())
            if b - a + 1 >= run:
                out.append((s, e, a, b, d))
    return out


def verified_stretch(x: np.ndarray, y: np.ndarray, d: int, run: int, threshold: float):
    """(first, last, their first, their last, similarity) of verified passages of grams x and y; d: how much further in x a passage stands."""
    sorter = np.argsort(y, kind="stable")
    where = np.searchsorted(y[sorter], x)
    hit = where < len(y)
    hit[hit] = y[sorter[where[hit]]] == x[hit]
    i = np.flatnonzero(hit)
    j = sorter[where[i]] if len(i) else i
    near = np.abs(i - j - d) <= 2 * SHIFT
    # a gram that stands several times on the other side is sought on the diagonal
    straight = i - d
    ok = (straight >= 0) & (straight < len(y))
    ok[ok] = y[straight[ok]] == x[i[ok]]
    j = np.where(ok, straight, j)
    i, j = i[near | ok], j[near | ok]
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i) > GAP) + 1):
        yield from verified(x, y, i[part], j[part], run, threshold)


def verified(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, run: int, threshold: float):
    """Longest stretches, from the left, that begin and end with matched grams (i of x with j of y) and reach the threshold."""
    if not len(i):
        return
    heads = np.append(0, np.flatnonzero(np.diff(i) > 1) + 1)
    tails = np.append(heads[1:] - 1, len(i) - 1)
    at = 0
    while at < len(heads):
        h, found = heads[at], None
        mine, other = i[tails] - i[h] + 1, j[tails] - j[h] + 1
        both = tails - h + 1
        fits = np.flatnonzero((np.arange(len(tails)) >= at) & (mine >= run) & (other >= run - 2 * SHIFT) & (both >= (threshold - 0.02) * (mine + other - both)))
        for e in fits[::-1]:
            p, q, u, v = int(i[h]), int(i[tails[e]]), int(j[h]), int(j[tails[e]])
            one, two = np.unique(x[p:q + 1]), np.unique(y[u:v + 1])
            n = len(np.intersect1d(one, two, assume_unique=True))
            if n >= threshold * (len(one) + len(two) - n):
                found = e
                yield p, q, u, v, n / (len(one) + len(two) - n)
                break
        at = at + 1 if found is None else found + 1


def repeated_passages(docs: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """key, start_word, end_word, rep_key, rep_start, rep_end, similarity: a passage and the one that represents it, ends exclusive."""
    run = least_words - GRAM + 1
    # rows that agree in key and text are one document
    base = docs.select(F.col(key).alias(key), "text", F.xxhash64(F.col(key), F.col("text")).alias("rid"))
    windows = base.select("rid", "text").mapInArrow(window_rows(run, hot_buckets(base, run)), "bucket long, rid long, place long, before int, after int")
    tied = (
        ties(windows).groupBy("low", "high").agg(F.collect_set(F.struct(F.col("low_place").alias("l"), F.col("high_place").alias("h"))).alias("ties"))
        .where(F.size(F.array_distinct(F.transform("ties", lambda t: F.shiftright(t["h"], 2 * run.bit_length()) % FUNCTIONS))) >= ENOUGH)
        .select("low", "high", F.col("ties.l").alias("theirs"), F.col("ties.h").alias("mine")))

    def plan(batches):
        """The stretches of each pair, packed, and what of either side they take."""
        for b in batches:
            rows = []
            theirs, mine = b.column("theirs"), b.column("mine")
            for i in range(b.num_rows):
                found = stretches(theirs[i].values.to_numpy(), mine[i].values.to_numpy(), run)
                if found:
                    x = np.array(found, np.int64)
                    a, s = int(x[:, 2].min()), int(x[:, 0].min())
                    rows.append((i, a, int(x[:, 3].max()) + GRAM - a, s, int(x[:, 1].max()) + GRAM - s, x.tobytes()))
            i, *columns = zip(*rows) if rows else [()] * 6
            i = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("low").take(i), b.column("high").take(i)] + [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())], names=["low", "high", "a", "n_a", "s", "n_s", "found"])

    pairs = written(tied.mapInArrow(plan, "low long, high long, a long, n_a long, s long, n_s long, found binary"), "pairs")
    wanted = written(pairs.select("low").unionByName(pairs.select(F.col("high").alias("low"))).distinct().withColumnRenamed("low", "rid"), "wanted")

    def read(batches):
        for rows, codes, words, lengths in token_chunks(batches, lowered, most=CHUNK):
            hashes, ends = word_hashes(codes, words), np.cumsum(lengths)
            yield from pa.table({"rid": rows.column("rid"), key: rows.column(key), "words": pa.array([hashes[e - k:e].tobytes() for e, k in zip(ends, lengths)], pa.binary())}).to_batches(max_chunksize=200)

    schema = T.StructType().add("rid", "long").add(key, docs.schema[key].dataType).add("words", "binary")
    whole = written(keyed(base, wanted, "rid", "left_semi").select("rid", key, "text").mapInArrow(read, schema), "words")
    if not whole.groupBy("rid").count().where("count > 1").isEmpty():
        whole = written(whole.dropDuplicates(["rid"]), "words")
    named = whole.select("rid", key)

    def verify(batches):
        for b in batches:
            rows = []
            for i, (a, s, found, theirs, mine) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "s", "found", "theirs", "mine")))):
                y, x = rolling(np.frombuffer(theirs, np.uint32)), rolling(np.frombuffer(mine, np.uint32))
                done: list[tuple[int, int]] = []
                for p, q, u, v, d in np.frombuffer(found, np.int64).reshape(-1, 5).tolist():
                    for f, t, g, h, sim in verified_stretch(x[p - s:q - s + 1], y[u - a:v - a + 1], d - p + u, run, threshold):
                        if not any(f + p >= low and t + p <= high for low, high in done):
                            done.append((f + p, t + p))
                            rows.append((i, f + p, t + p + GRAM, g + u, h + u + GRAM, sim))
            i, *columns = zip(*rows) if rows else [()] * 6
            i = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("low").take(i), b.column("high").take(i)] + [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.float64())], names=["low", "high", "start_word", "end_word", "rep_start", "rep_end", "similarity"])

    def taken(first, n):
        return F.substring(F.col("words"), (F.col(first) * 4 + 1).cast("int"), (F.col(n) * 4).cast("int"))

    # both sides are the same table dealt by the same column, so that its shuffle is shared
    side = whole.select(F.col("rid").alias("r"), "words")
    part = pairs.join(side, F.col("low") == F.col("r")).select("low", "high", "a", "s", "n_s", "found", taken("a", "n_a").alias("theirs"))
    both = part.join(side, F.col("high") == F.col("r")).select("low", "high", "a", "s", "found", "theirs", taken("s", "n_s").alias("mine"))
    found = written(both.mapInArrow(verify, "low long, high long, start_word long, end_word long, rep_start long, rep_end long, similarity double"), "passages")
    out = found.join(named.withColumnRenamed("rid", "high"), "high").join(named.select(F.col("rid").alias("low"), F.col(key).alias(f"rep_{key}")), "low")
    return out.select(key, "start_word", "end_word", f"rep_{key}", "rep_start", "rep_end", "similarity")
