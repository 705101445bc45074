"""Interpolated modified Kneser-Ney model of order two or three, counted in Spark, kept as sorted hash arrays.

Training: every task turns its texts into distinct n-grams with counts and
sends each to the shard of its context's hash, packed as arrays. A shard adds
them up and writes one file of sorted arrays in the shared folder: the bigram
hashes with counts, and by word the count and the numbers of continuations
seen once, twice and more often. A second, smaller shuffle brings each
word's number of distinct predecessors. Tasks write whole files under another
name and move them into place, so a task that runs again changes nothing.

Scoring: tasks memory-map the files, of which the page cache holds one copy a
machine, and join the sorted n-grams of a chunk of texts with each shard.

With c a count, D the three discounts by count (1, 2, 3 or more) and N1, N2,
N3 the numbers of words seen once, twice, more often after v:
p(w|v) = max(c(vw) - D, 0) / c(v) + (D1*N1 + D2*N2 + D3*N3) / c(v) * p(w), and
p(w) likewise from numbers of distinct predecessors, above 1/(V+1), where V
counts the training words and one more stands for all unknown words.

Order three puts one level on top: a first shuffle sends trigrams to the shard
of their two words of context, which keeps their counts and hands every bigram
on with its number of distinct predecessors there. The steps below then run as
they are, with those numbers in the place of counts. Two marks stand before a
text's first word.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_TOKENS, hash_words, local_path, lowered, mix, new_path, replace_file, shards, small_batches, token_chunks

#: Hashes of the mark before a text's first word, and of the end, which counts as a token.
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)
#: The mark before that one, for contexts of two words.
FIRST = np.uint64(0x9FB21C651E98DF25)
#: Counts from here on stand in arrays of their own; the others take a byte.
LARGE = 255
#: Bytes of text that one shard of the counts is made for.
SHARD_BYTES = 32 << 20
PARTS = "shard int, words binary, counts binary, contexts binary, lengths binary, nexts binary, pairs binary"
TRIPLE_PARTS = "shard int, words binary, counts binary, pairs binary, seconds binary, lengths binary, nexts binary, triples binary"
BELOW = PARTS + ", t1 long, t2 long, t3 long, t4 long"
STATS = "shard int, n1 long, n2 long, n3 long, n4 long, tokens long, types long, bigrams long, words binary, counts binary"


def sequences(codes: np.ndarray, lengths: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor and the token, ends included; n_words stands for begin and end. lengths: with the ends."""
    ends = np.cumsum(lengths) - 1
    nexts = np.full(int(lengths.sum()), n_words, np.int64)
    body = np.ones(len(nexts), bool)
    body[ends] = False
    nexts[body] = codes
    before = np.empty_like(nexts)
    before[1:] = nexts[:-1]
    if len(before):
        before[0] = n_words
    return before, nexts


def count_parts(n_shards: int, most: int):
    def run(batches):
        for _, codes, words, lengths in token_chunks(batches, lowered, 1, most):
            before, nexts = sequences(codes, lengths, len(words))
            hashes = np.append(hash_words(words), END)
            contexts = np.append(hashes[:-1], BEGIN)
            counts = np.bincount(nexts, minlength=len(hashes))
            pairs, pair_counts = np.unique(before * len(hashes) + nexts, return_counts=True)
            v, w = np.divmod(pairs, len(hashes))
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            runs = np.diff(np.append(starts, len(v)))
            context_shard = (contexts[v[starts]] % np.uint64(n_shards)).astype(np.int64)
            pair_shard = np.repeat(context_shard, runs)
            word_shard = (hashes % np.uint64(n_shards)).astype(np.int64)
            by_pair, by_context, by_word = (np.argsort(x, kind="stable") for x in (pair_shard, context_shard, word_shard))
            edges = [np.searchsorted(x[i], np.arange(n_shards + 1)) for x, i in ((pair_shard, by_pair), (context_shard, by_context), (word_shard, by_word))]
            rows = []
            for s in range(n_shards):
                p, c, k = (i[e[s]:e[s + 1]] for i, e in zip((by_pair, by_context, by_word), edges))
                if len(p) + len(k):
                    rows.append((s, hashes[k].tobytes(), counts[k].astype(np.uint32).tobytes(), contexts[v[starts[c]]].tobytes(), runs[c].astype(np.uint32).tobytes(), hashes[w[p]].tobytes(), pair_counts[p].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 6)], names=["shard", "words", "counts", "contexts", "lengths", "nexts", "pairs"])
    return run


def count_triples(n_shards: int, most: int):
    def run(batches):
        for _, codes, words, lengths in token_chunks(batches, lowered, 1, most):
            before, nexts = sequences(codes, lengths, len(words))
            first = before_that(before, lengths, len(words))
            hashes = np.append(hash_words(words), END)
            contexts = np.append(hashes[:-1], [BEGIN, FIRST])
            n = len(contexts)
            counts = np.bincount(nexts, minlength=len(hashes))
            pairs, which = np.unique(first * n + before, return_inverse=True)
            triples, triple_counts = np.unique(which * len(hashes) + nexts, return_counts=True)
            p, w = np.divmod(triples, len(hashes))
            runs = np.bincount(p, minlength=len(pairs))
            u, v = np.divmod(pairs, n)
            pair_hash = mix(contexts[u], contexts[v])
            pair_shard = (pair_hash % np.uint64(n_shards)).astype(np.int64)
            word_shard = (hashes % np.uint64(n_shards)).astype(np.int64)
            by_triple, by_pair, by_word = (np.argsort(x, kind="stable") for x in (pair_shard[p], pair_shard, word_shard))
            edges = [np.searchsorted(x[i], np.arange(n_shards + 1)) for x, i in ((pair_shard[p], by_triple), (pair_shard, by_pair), (word_shard, by_word))]
            rows = []
            for s in range(n_shards):
                t, c, k = (i[e[s]:e[s + 1]] for i, e in zip((by_triple, by_pair, by_word), edges))
                if len(t) + len(c) + len(k):
                    rows.append((s, hashes[k].tobytes(), counts[k].astype(np.uint32).tobytes(), pair_hash[c].tobytes(), contexts[v[c]].tobytes(), runs[c].astype(np.uint32).tobytes(), hashes[w[t]].tobytes(), triple_counts[t].astype(np.uint32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 7)], names=["shard", "words", "counts", "pairs", "seconds", "lengths", "nexts", "triples"])
    return run


def before_that(before: np.ndarray, lengths: np.ndarray, n_words: int) -> np.ndarray:
    """Each token's last but one predecessor; n_words stands for begin, n_words + 1 for the mark before it."""
    first = np.empty_like(before)
    first[1:] = before[:-1]
    first[np.cumsum(lengths) - lengths] = n_words + 1
    return first


def joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of each one's values, and where each stood first."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values[order].astype(np.int64), starts) if len(keys) else values.astype(np.int64), order[starts]


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    def write(f):
        at, head = 0, {}
        for k, x in arrays.items():
            head[k] = (at, len(x), x.dtype.str)
            at += -(-x.nbytes // 64) * 64
        text = json.dumps(head).encode().ljust(1024)
        assert len(text) == 1024
        f.write(text)
        for x in arrays.values():
            f.write(x.tobytes().ljust(-(-x.nbytes // 64) * 64, b"\0"))
    replace_file(path, write)


def read_arrays(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    head = json.loads(bytes(raw[:1024]))
    return {k: raw[1024 + at:1024 + at + n * np.dtype(t).itemsize].view(t) for k, (at, n, t) in head.items()}


def write_triples(folder: str, n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        lengths = joined(table, "lengths", np.uint32)
        pair = np.repeat(joined(table, "pairs", np.uint64), lengths)
        second = np.repeat(joined(table, "seconds", np.uint64), lengths)
        nexts = joined(table, "nexts", np.uint64)
        key, count, at = summed(mix(pair, nexts), joined(table, "triples", np.uint32))
        pair, second, nexts = pair[at], second[at], nexts[at]
        pairs, of = np.unique(pair, return_inverse=True)
        n = [np.bincount(of, weights=np.minimum(count, 3) == k, minlength=len(pairs)).astype(np.uint32) for k in (1, 2, 3)]
        large = count >= LARGE
        write_arrays(f"{folder}/triples-{s}", {"key": key, "count": np.minimum(count, LARGE).astype(np.uint8), "large_key": key[large], "large_count": count[large].astype(np.uint64), "word": pairs, "follow": np.bincount(of, weights=count, minlength=len(pairs)).astype(np.uint64), "n1": n[0], "n2": n[1], "n3": n[2]})
        # the level below: bigrams with how many contexts of this shard stand before them
        order = np.lexsort((nexts, second))
        second, nexts = second[order], nexts[order]
        starts = np.flatnonzero(np.append(True, (second[1:] != second[:-1]) | (nexts[1:] != nexts[:-1]))) if len(second) else np.zeros(0, np.int64)
        before = np.diff(np.append(starts, len(second)))
        second, nexts = second[starts], nexts[starts]
        to = (second % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(n_shards + 1))
        rows = [(s, b"".join(table.column("words").to_pylist()), b"".join(table.column("counts").to_pylist()), b"", b"", b"", b"", *(int((count == k).sum()) for k in (1, 2, 3, 4)))]
        for k in range(n_shards):
            if len(i := order[edges[k]:edges[k + 1]]):
                own = second[i]
                runs = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                rows.append((k, b"", b"", own[runs].tobytes(), np.diff(np.append(runs, len(own))).astype(np.uint32).tobytes(), nexts[i].tobytes(), before[i].astype(np.uint32).tobytes(), 0, 0, 0, 0))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 6 + [pa.int64()] * 4)], names=["shard", "words", "counts", "contexts", "lengths", "nexts", "pairs", "t1", "t2", "t3", "t4"])
    return run


def write_shard(folder: str, n_shards: int, followed: bool = False):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        word, total, _ = summed(joined(table, "words", np.uint64), joined(table, "counts", np.uint32))
        context = np.repeat(joined(table, "contexts", np.uint64), joined(table, "lengths", np.uint32))
        nexts = joined(table, "nexts", np.uint64)
        key, count, first = summed(mix(context, nexts), joined(table, "pairs", np.uint32))
        context, nexts = context[first], nexts[first]
        contexts, at = np.unique(context, return_inverse=True)
        where = np.searchsorted(word, contexts)
        if len(contexts) and len(missing := contexts[(where >= len(word)) | (word[np.minimum(where, len(word) - 1)] != contexts)] if len(word) else contexts):  # the mark before the first word is no token
            word, order = (x := np.append(word, missing))[o := np.argsort(x, kind="stable")], o
            total = np.append(total, np.zeros(len(missing), np.int64))[order]
            where = np.searchsorted(word, contexts)
        n = [np.bincount(where[at], weights=(c := np.minimum(count, 3)) == k, minlength=len(word)).astype(np.uint32) for k in (1, 2, 3)]
        follow = np.bincount(where[at], weights=count, minlength=len(word)) if len(word) else np.zeros(0)
        if len(i := np.flatnonzero(word == BEGIN)):  # as a context it counts as often as it begins a text
            total[i] = 0
            begin = int(follow[i[0]])
        else:
            begin = 0
        large = count >= LARGE
        write_arrays(f"{folder}/shard-{s}", {"key": key, "count": np.minimum(count, LARGE).astype(np.uint8), "large_key": key[large], "large_count": count[large].astype(np.uint64), "word": word, "total": total.astype(np.uint64), "n1": n[0], "n2": n[1], "n3": n[2], "begin": np.array([begin], np.uint64)} | ({"follow": follow.astype(np.uint64)} if followed else {}))
        of = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        next_word, preceded = np.unique(nexts, return_counts=True)
        to = (next_word % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(n_shards + 1))
        rows = [(s, *of, int(total.sum()), int((total > 0).sum()), len(key), b"", b"")]
        for k in range(n_shards):
            if len(i := order[edges[k]:edges[k + 1]]):
                rows.append((k, 0, 0, 0, 0, 0, 0, 0, next_word[i].tobytes(), preceded[i].astype(np.uint32).tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.int64()] * 7 + [pa.binary()] * 2)], names=["shard", "n1", "n2", "n3", "n4", "tokens", "types", "bigrams", "words", "counts"])
    return run


def write_preceded(folder: str):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        word = read_arrays(f"{folder}/shard-{s}")["word"]
        keys, n, _ = summed(joined(table, "words", np.uint64), joined(table, "counts", np.uint32))
        preceded = np.zeros(len(word), np.uint32)
        preceded[np.searchsorted(word, keys)] = n
        write_arrays(f"{folder}/preceded-{s}", {"preceded": preceded})
        return pa.table({"shard": pa.array([s], pa.int32())} | {f"n{k}": pa.array([int((preceded == k).sum())], pa.int64()) for k in (1, 2, 3, 4)} | {"more": pa.array([int((preceded > 2).sum())], pa.int64())})
    return run


def discounts(n: list[int]) -> list[float]:
    """Of counts 1, 2, 3 or more, from how many n-grams have counts 1..4; in range where a class is empty."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return [min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(raw, 1)]


def corpus_shards(docs: DataFrame) -> int:
    """Shards for all of ``docs``: by the bytes of their texts, and no fewer than the session's shuffle partitions."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    return max(shards(docs.sparkSession), -(-size // SHARD_BYTES))


def by_shard(parts: DataFrame, n_shards: int):
    """Groups of shards, in about as many tasks as there are shards."""
    return parts.repartition(n_shards, "shard").groupBy("shard")


def train(docs: DataFrame, order: int = 2, n_shards: int | None = None, most: int = CHUNK_TOKENS) -> dict:
    """The model of column ``text`` (null: empty) of ``docs``, of order 2 or 3; its arrays are in the shared folder.

    Every row is one text; repeated rows count each time. No row at all gives
    a model in which every word is unknown. n_shards: files that the model is
    cut into, each of which one task counts (``corpus_shards`` for a corpus
    that grows); the session's shuffle partitions unless given. most:
    tokens that a task counts at once, memory against shuffle.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    n_shards = n_shards or shards(spark)
    url = new_path(spark, "kneser-ney")
    folder = local_path(url)
    top, triples = None, ()
    if order == 2:
        parts = docs.select("text").mapInArrow(count_parts(n_shards, most), PARTS)
    else:
        counted = docs.select("text").mapInArrow(count_triples(n_shards, most), TRIPLE_PARTS)
        counted = by_shard(counted, n_shards).applyInArrow(write_triples(folder, n_shards), BELOW)
        counted.write.parquet(f"{url}/below")
        below = spark.read.parquet(f"{url}/below")
        three = below.agg(*(F.coalesce(F.sum(f"t{k}"), F.lit(0)).alias(f"t{k}") for k in (1, 2, 3, 4))).first()
        top = discounts([three[f"t{k}"] for k in (1, 2, 3, 4)])
        # each shard of trigrams gives one row without contexts
        triples = [r["shard"] for r in below.where(F.length("contexts") == 0).select("shard").distinct().collect()]
        parts = below.select("shard", "words", "counts", "contexts", "lengths", "nexts", "pairs")
    stats_path = f"{url}/stats"
    by_shard(parts, n_shards).applyInArrow(write_shard(folder, n_shards, order > 2), STATS).write.parquet(stats_path)
    stats = spark.read.parquet(stats_path)
    one = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "tokens", "types", "bigrams"))).first()
    low = stats.where(F.length("words") > 0).select("shard", "words", "counts").groupBy("shard").applyInArrow(write_preceded(folder), "shard int, n1 long, n2 long, n3 long, n4 long, more long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "more")), F.collect_set("shard").alias("shards")).first()
    # the files there are, at most one of a shard each, so that a missing one is no empty shard
    files = [r["shard"] for r in stats.where(F.length("words") == 0).select("shard").distinct().collect()]
    d = discounts([one[f"n{k}"] for k in (1, 2, 3, 4)])
    e = discounts([low[f"n{k}"] for k in (1, 2, 3, 4)])
    spread = (e[0] * low["n1"] + e[1] * low["n2"] + e[2] * low["more"]) / one["bigrams"] if one["bigrams"] else 1.0
    return {"folder": folder, "order": order, "top": top, "triples": frozenset(triples), "shards": n_shards, "files": frozenset(files), "preceded": frozenset(low["shards"]), "tokens": one["tokens"], "types": one["types"], "bigrams": one["bigrams"], "high": d, "low": e, "spread": spread}


def look_up(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, where each is in the sorted table, and whether."""
    at = np.searchsorted(table, keys)
    found = at < len(table)
    found[found] = table[at[found]] == keys[found]
    return at, found


class Model:
    """A trained model, memory-mapped in a task."""

    def __init__(self, meta: dict):
        self.meta = meta
        self.maps: dict[int, dict] = {}

    def shard(self, s: int) -> dict:
        """A shard's arrays; empty where no word fell into it. A file that was written and is not there is an error."""
        if s not in self.maps:
            if s not in self.meta["files"]:
                self.maps[s] = {}
            else:
                try:
                    self.maps[s] = read_arrays(f"{self.meta['folder']}/shard-{s}")
                    if s in self.meta["preceded"]:
                        self.maps[s] |= read_arrays(f"{self.meta['folder']}/preceded-{s}")
                    else:  # no word of this shard has a predecessor
                        self.maps[s]["preceded"] = np.zeros(len(self.maps[s]["word"]), np.uint32)
                except FileNotFoundError as e:
                    raise FileNotFoundError(f"the model's file {e.filename} is not there: spark.checkpoint.dir has to be mounted on every machine") from e
        return self.maps[s]

    def triples(self, s: int) -> dict:
        """A shard's trigrams and their contexts; empty where none fell into it."""
        if s not in self.meta["triples"]:
            return {}
        if (s, 3) not in self.maps:
            try:
                self.maps[s, 3] = read_arrays(f"{self.meta['folder']}/triples-{s}")
            except FileNotFoundError as e:
                raise FileNotFoundError(f"the model's file {e.filename} is not there: spark.checkpoint.dir has to be mounted on every machine") from e
        return self.maps[s, 3]

    def by_shard(self, keys: np.ndarray, of: np.ndarray, shard=None):
        """(shard's arrays, indexes of its keys in ascending order) by shard; shard: which arrays, those of words and bigrams unless given."""
        order = np.lexsort((keys, of))
        edges = np.searchsorted(of[order], np.arange(self.meta["shards"] + 1))
        for s in np.flatnonzero(np.diff(edges)):
            if arrays := (shard or self.shard)(int(s)):
                yield arrays, order[edges[s]:edges[s + 1]]

    def score(self, codes: np.ndarray, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """By text: known tokens, log10 add-one unigram score, log10 score of the model."""
        meta, n = self.meta, np.uint64(self.meta["shards"])
        before, nexts = sequences(codes, lengths, len(words))
        hashes = np.append(hash_words(words), END)
        contexts = np.append(hashes[:-1], BEGIN)
        both = np.append(hashes, BEGIN)  # what is looked up: the words, end, begin
        total, follow, preceded, n1, n2, n3 = (np.zeros(len(both)) for _ in range(6))
        for arrays, i in self.by_shard(both, (both % n).astype(np.int64)):
            at, found = look_up(both[i], arrays["word"])
            i, at = i[found], at[found]
            for to, name in ((total, "total"), (preceded, "preceded"), (n1, "n1"), (n2, "n2"), (n3, "n3")):
                to[i] = arrays[name][at]
            # at order two a word is followed as often as it stands there
            follow[i] = (arrays["follow"] if meta["order"] > 2 else arrays["total"])[at]
            if len(begin := i[both[i] == BEGIN]):
                follow[begin] = arrays["begin"][0]
        high, low = meta["high"], meta["low"]
        discount = np.select([preceded > 2, preceded > 1, preceded > 0], [low[2], low[1], low[0]], 0.0)
        unigram = ((preceded - discount) / max(1, meta["bigrams"]) + meta["spread"] / (meta["types"] + 1))[:-1]
        as_context = np.append(follow[:-2], follow[-1])  # begin in the place of end
        sums = (high[0] * n1 + high[1] * n2 + high[2] * n3)
        sums = np.append(sums[:-2], sums[-1])
        back = np.where(as_context > 0, sums / np.maximum(as_context, 1), 1.0)

        pairs, which = np.unique(before * len(hashes) + nexts, return_inverse=True)
        v, w = np.divmod(pairs, len(hashes))
        count = self.counts(mix(contexts[v], hashes[w]), contexts[v], self.shard)
        off = np.select([count > 2, count > 1, count > 0], [high[2], high[1], high[0]], 0.0)
        p = (count - off) / np.maximum(as_context[v], 1) + back[v] * unigram[w]
        if meta["order"] > 2:
            p, which = self.over_pairs(p, which, before, nexts, lengths, hashes, contexts)
        starts = np.cumsum(lengths) - lengths
        base = np.log10((total[:-1] + 1) / (meta["tokens"] + meta["types"] + 1))
        return tuple(np.add.reduceat(x, starts) for x in ((total[:-1] > 0)[nexts].astype(np.int64), base[nexts], np.log10(p)[which]))


    def counts(self, keys: np.ndarray, contexts: np.ndarray, shard) -> np.ndarray:
        """Counts of n-grams, 0 for unknown ones."""
        count = np.zeros(len(keys))
        for arrays, i in self.by_shard(keys, (contexts % np.uint64(self.meta["shards"])).astype(np.int64), shard):
            at, found = look_up(keys[i], arrays["key"])
            i, at = i[found], at[found]
            count[i] = arrays["count"][at]
            if len(big := i[count[i] == LARGE]):
                count[big] = arrays["large_count"][np.searchsorted(arrays["large_key"], keys[big])]
        return count

    def over_pairs(self, p: np.ndarray, which: np.ndarray, before: np.ndarray, nexts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the distinct trigrams, given those of the bigrams, and each token's trigram."""
        first = before_that(before, lengths, len(hashes) - 1)
        contexts = np.append(contexts, FIRST)
        pairs, of = np.unique(first * len(contexts) + before, return_inverse=True)
        triples, at_token, which3 = np.unique(of * len(hashes) + nexts, return_index=True, return_inverse=True)
        c, w = np.divmod(triples, len(hashes))
        u, v = np.divmod(pairs, len(contexts))
        pair = mix(contexts[u], contexts[v])
        follow, n1, n2, n3 = (np.zeros(len(pairs)) for _ in range(4))
        for arrays, i in self.by_shard(pair, (pair % np.uint64(self.meta["shards"])).astype(np.int64), self.triples):
            at, found = look_up(pair[i], arrays["word"])
            i, at = i[found], at[found]
            for to, name in ((follow, "follow"), (n1, "n1"), (n2, "n2"), (n3, "n3")):
                to[i] = arrays[name][at]
        top = self.meta["top"]
        back = np.where(follow > 0, (top[0] * n1 + top[1] * n2 + top[2] * n3) / np.maximum(follow, 1), 1.0)
        count = self.counts(mix(pair[c], hashes[w]), pair[c], self.triples)
        off = np.select([count > 2, count > 1, count > 0], [top[2], top[1], top[0]], 0.0)
        return (count - off) / np.maximum(follow[c], 1) + back[c] * p[which[at_token]], which3


def score(docs: DataFrame, meta: dict, most: int = CHUNK_TOKENS) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score of each text (null: empty). most: tokens that a task scores at once."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep).schema
    for c in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(c, "long")
    for c in ("base_score", "score"):
        schema = schema.add(c, "double")

    def run(batches):
        model = Model(meta)
        for rows, codes, words, lengths in token_chunks(batches, lowered, 1, most):
            known, base, own = model.score(codes, words, lengths)
            columns = [rows.column(c) for c in keep] + [pa.array(lengths), pa.array(known, pa.int64()), pa.array(np.full(len(lengths), meta["tokens"], np.int64)), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
            yield from pa.table(dict(zip(schema.names, columns))).to_batches()

    return docs.select(*keep, "text").mapInArrow(run, schema)
