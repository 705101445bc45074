"""Operator 5: quality rules as a short-circuit cascade.

Every rule rejects documents by one signal. On a bounded sample of documents
(at most ``SAMPLE`` of up to ``SAMPLE_CHARS`` characters, chosen by hash from the whole table, for the order alone) each rule's time a document and share of
rejected documents are measured; the rules then run in descending order of
rejection per cost, each only over documents that no earlier one rejected. The
order changes the work, never the verdicts: a document is kept if no rule
rejects it. The base signals are part of the result and so are taken of every
document; the rules on them only compare. ``character_entropy``, ``links``,
``exclamations`` and ``capitals`` read the text themselves, so that the order
saves their work (``cascade_work`` tells how much).

Defined cases: a null text has no words and is rejected by ``few_words``;
repeated rows are judged each; equal rates order rules by name; a very long
text is judged whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import time
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import plain, token_chunks

SAMPLE, SAMPLE_CHARS = 300, 50_000
#: Least bits a character, and most links of ten words.
LEAST_BITS, MOST_LINKS = 2.0, 3
LINK = re.compile(r"(?i)(?:https?://|www\.)")
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def entropy(text: str) -> float:
    """Bits a character by the text's own character counts; 0 for an empty text."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


#: name: (text, signals of the document) -> rejected
RULES: dict[str, Callable[[str, dict], bool]] = {
    "few_words": lambda text, s: s["n_words"] < 10,
    "repeated_words": lambda text, s: 100 * s["n_repeat_words"] > 20 * s["n_words"],
    "symbols": lambda text, s: 10 * s["n_symbols"] > 3 * s["n_words"],
    "word_length": lambda text, s: not 2 * s["n_words"] <= s["word_chars"] <= 15 * s["n_words"],
    "duplicate_lines": lambda text, s: s["n_dup_lines"] > 2 and 100 * s["n_dup_lines"] > 30 * s["n_lines"],
    "exclamations": lambda text, s: 10 * text.count("!") > 3 * s["n_words"],
    "capitals": lambda text, s: 2 * len(re.sub("[^A-Z]+", "", text)) > len(re.sub("[^A-Za-z]+", "", text)),
    "character_entropy": lambda text, s: entropy("".join(text.split())) < LEAST_BITS,
    "links": lambda text, s: 10 * len(LINK.findall(text)) > MOST_LINKS * s["n_words"],
}
BASE = ("few_words", "repeated_words")


def window_words(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """By text: words in windows of five words that the text holds twice or more."""
    if not len(codes):
        return np.zeros(len(lengths), np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)

    def pair(a, b):  # one exact code for two
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    n = len(codes) - WINDOW + 1
    covered = np.zeros(len(codes) + 1, np.int64)
    if n > 0:
        two = pair(codes[:-1], codes[1:])
        five = pair(pair(two[:n], two[2:2 + n]), codes[4:4 + n])
        whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
        _, which, times = np.unique(doc[whole] * (int(five.max()) + 1) + five[whole], return_inverse=True, return_counts=True)
        starts = whole[times[which] > 1]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(covered[:-1]) > 0, minlength=len(lengths)).astype(np.int64)


def signals(text: str, n_words: int, n_repeat: int) -> dict:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return {"n_words": n_words, "word_chars": len(text) - sum(map(text.count, SPACES)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": n_repeat, "n_lines": len(lines)}


def measured(texts: list[str]):
    """(text, signals) of each text."""
    table = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for rows, codes, _, lengths in token_chunks([table] if texts else [], plain):
        for text, n, r in zip(rows.column("text").to_pylist(), lengths.tolist(), window_words(codes, lengths).tolist()):
            yield text or "", signals(text or "", n, r)


def cascade_order(docs: DataFrame, rules: dict = RULES, sample: int = SAMPLE) -> list[str]:
    """The rules' names by rejected documents per second, from documents of bounded length chosen by hash; ties by name."""
    some = docs.where(F.length("text") <= SAMPLE_CHARS).select("text")
    share = min(1.0, 2 * sample / max(1, docs.count()))
    chosen = some.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample).collect()
    rows, rate = list(measured([r.text for r in chosen])), {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = sum(bool(rule(*x)) for x in rows)
        rate[name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda k: (-rate[k], k))


def cascade_work(docs: DataFrame, rules: dict = RULES, order: list[str] | None = None) -> DataFrame:
    """position, rule, evaluated and rejected: on how many documents each rule of the cascade runs, and how many it rejects."""
    order = order or cascade_order(docs, rules)

    def run(batches):
        for rows, codes, _, lengths in token_chunks(batches, plain):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            left, counts = [(t, signals(t, n, r)) for t, n, r in zip(texts, lengths.tolist(), window_words(codes, lengths).tolist())], []
            for name in order:
                passed = [x for x in left if not rules[name](*x)]
                counts.append((len(left), len(left) - len(passed)))
                left = passed
            yield pa.RecordBatch.from_pydict({"position": pa.array(range(1, len(order) + 1), pa.int32()), "rule": order, "evaluated": [c[0] for c in counts], "rejected": [c[1] for c in counts]})

    return docs.select("text").mapInArrow(run, "position int, rule string, evaluated long, rejected long").groupBy("position", "rule").agg(F.sum("evaluated").alias("evaluated"), F.sum("rejected").alias("rejected"))


def quality_rules(docs: DataFrame, key: str = "doc_id", rules: dict = RULES, order: list[str] | None = None) -> DataFrame:
    """key, the signals, base_failed and kept of each row of ``docs``."""
    order = order or cascade_order(docs, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = docs.select(key).schema
    for c in names:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")

    def run(batches):
        for rows, codes, _, lengths in token_chunks(batches, plain):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            every = [signals(*x) for x in zip(texts, lengths.tolist(), window_words(codes, lengths).tolist())]
            left = list(range(len(texts)))
            for name in order:
                rule = rules[name]
                left = [i for i in left if not rule(texts[i], every[i])]
            kept = np.zeros(len(texts), bool)
            kept[left] = True
            failed = [any(RULES[b](t, s) for b in BASE) for t, s in zip(texts, every)]
            columns = [rows.column(key)] + [pa.array([s[c] for s in every], pa.int64()) for c in names] + [pa.array(failed, pa.bool_()), pa.array(kept & ~np.array(failed, bool))]
            yield from pa.table(dict(zip(schema.names, columns))).to_batches()

    return docs.select(key, "text").mapInArrow(run, schema)
