"""Operator 4: benchmark decontamination by pigeonhole edit matching.

Words (lower case, letters and digits) are the symbols. A test item of m words
may occur with up to k = floor(rate * m) word edits. Split into k + 1 pieces,
one of them has to occur unchanged, so an automaton finds exact pieces in every
text, and Myers' bit-parallel distance then verifies the whole item around
each hit. The items go to the tasks in blocks of bounded size, each searched in
all texts, however many blocks there are.

Defined cases: an item under ten words has no error budget and is found only
as it stands, however short; ``contaminations`` reports it with its number of
words. ``decontaminated`` takes documents away only for items of ``least_words``
words or more, as shorter ones cannot be told from ordinary prose. A null or
empty text matches nothing; repeated rows of texts are searched each; repeated
items each match; a null item, or one without words, matches nothing; an item
occurring more than once in a text gives its best place, the first of equals;
empty tables of texts or items give no matches; other columns are ignored by
``contaminations`` and kept by ``decontaminated``.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

RATE, LEAST_WORDS = 0.1, 8
#: Characters of the items that tasks search at once.
BLOCK_CHARS = 8_000_000
WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def pieces(item: list[str], rate: float) -> list[tuple[int, list[str]]]:
    """(offset, words) of the item's error budget plus one pieces, of nearly equal length."""
    n = int(rate * len(item)) + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def best_end(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the first end of such a stretch (Myers)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        x = at.get(w, 0) | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp, hn = minus | (full & ~(d | plus)), plus & d
        score += 1 if hp & high else -1 if hn & high else 0
        hp = hp << 1 & full
        plus, minus = (hn << 1 & full) | (full & ~(d | hp)), hp & d
        if score < best:
            best, end = score, j
    return best, end


class Searcher:
    """Finds a block of items (id, words) in texts."""

    def __init__(self, items: list[tuple], rate: float):
        self.items = items
        self.budget = [int(rate * len(w)) for _, w in items]
        found: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, item) in enumerate(items):
            for offset, piece in pieces(item, rate):
                found.setdefault(f" {' '.join(piece)} ", []).append((i, offset, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for k, v in found.items():
            self.automaton.add_word(k, v)
        if found:
            self.automaton.make_automaton()

    def search(self, text: str | None):
        """(item's id, distance, first word, end word) of the items in the text."""
        if not self.items:
            return
        ws = words(text)
        joined = f" {' '.join(ws)} "
        places: dict[int, set[int]] = {}
        gaps = None
        for end, hits in self.automaton.iter(joined):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
            after = int(np.searchsorted(gaps, end))  # words up to the piece's end
            for i, offset, n in hits:
                places.setdefault(i, set()).add(after - n - offset)
        for i, starts in places.items():
            name, item = self.items[i]
            k, best = self.budget[i], None
            covered = -1
            for s in sorted(starts):
                low, high = max(0, s - k), min(len(ws), s + len(item) + k)
                if high <= covered:
                    continue
                covered = high
                d, end = best_end(item, ws[low:high])
                if d <= k and (best is None or d < best[0]):
                    end += low
                    back, length = best_end(item[::-1], ws[max(0, end - len(item) - k):end][::-1])
                    best = (d, end - length, end)
            if best:
                yield name, *best


def item_blocks(benchmark: DataFrame, item_key: str, least_words: int):
    """The items (id, words) in blocks of about BLOCK_CHARS characters, read one partition at a time."""
    block, chars = [], 0
    for r in benchmark.select(item_key, "text").toLocalIterator():
        w = words(r[1])
        if w and len(w) >= least_words:
            block.append((r[0], w))
            chars += len(r[1])
            if chars >= BLOCK_CHARS:
                yield block
                block, chars = [], 0
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", rate: float = RATE, least_words: int = 1) -> DataFrame:
    """key, item_key, distance, first_word, end_word (words of the text, end exclusive), item_words of each text and item in it."""
    small_batches(docs.sparkSession)
    schema = docs.select(key).schema.add("item", benchmark.schema[item_key].dataType)
    for c in ("distance", "first_word", "end_word", "item_words"):
        schema = schema.add(c, "integer")
    spark, out = docs.sparkSession, None

    def search(items):
        shared = spark.sparkContext.broadcast(items)

        def run(batches):
            searcher = Searcher(shared.value, rate)
            length = {name: len(w) for name, w in shared.value}
            for batch in batches:
                rows = [(i, *x, length[x[0]]) for i, t in enumerate(batch.column("text")) for x in searcher.search(t.as_py())]
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))] + [pa.array([r[k] for r in rows], pa.int32() if k > 1 else None) for k in range(1, 6)]
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return docs.select(key, "text").mapInArrow(run, schema)

    for items in item_blocks(benchmark, item_key, least_words):
        part = search(items)
        out = part if out is None else out.unionByName(part)
    return (out if out is not None else spark.createDataFrame([], schema)).withColumnRenamed("item", item_key)


def decontaminated(docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", rate: float = RATE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` whose texts hold no test item; no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)

    def without(df, items):
        shared = spark.sparkContext.broadcast(items)

        def run(batches):
            searcher = Searcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([next(searcher.search(t.as_py()), None) is None for t in batch.column("text")], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    for items in item_blocks(benchmark, item_key, least_words):
        docs = without(docs, items)
    return docs
