"""Operator 9: greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, for pieces at a word's start and for
pieces that go on inside a word. A node's failure link is the node that
remains after the longest pieces that its string surely begins with are
popped; how many pieces that pops is kept with the link, so that matching adds
up counts and never builds pieces. Each byte is read once, and failure steps
are bounded by the pieces popped, so a word takes linear time.

A word with no complete match counts as one unknown piece. Within a chunk
each distinct word is matched once. The automaton's size is bounded by the
vocabulary, whose file is a parameter.

Defined cases: a null or empty text has no words; repeated rows are counted
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import plain, token_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """Pieces at a word's start (in the file with a leading space) and inside words, of a rank file."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


class Automaton:
    """Pieces of ``first`` begin a word, those of ``inside`` continue it; ``prefix`` goes before each word."""

    def __init__(self, first: list[bytes], inside: list[bytes], prefix: bytes = b""):
        self.prefix = prefix
        self.goto: dict[int, int] = {}  # node * 256 + byte: node; node 0: word start, node 1: inside
        self.link, self.popped = [-1, -1], [0, 0]
        ends = set()
        for root, pieces in ((0, first), (1, inside)):
            for piece in pieces:
                node = root
                for byte in piece:
                    to = self.goto.get(node << 8 | byte)
                    if to is None:
                        to = self.goto[node << 8 | byte] = len(self.link)
                        self.link.append(-1)
                        self.popped.append(0)
                    node = to
                if piece:
                    ends.add(node)
        children: dict[int, list[tuple[int, int]]] = {}
        for k, to in self.goto.items():
            children.setdefault(k >> 8, []).append((k & 255, to))
        queue = deque([0, 1])
        while queue:  # by length of the string, so that links of shorter ones are known
            node = queue.popleft()
            for byte, to in children.get(node, ()):
                queue.append(to)
                if to in ends:
                    self.link[to], self.popped[to] = 1, 1
                    continue
                at, n = self.link[node], self.popped[node]
                while at >= 0 and (at << 8 | byte) not in self.goto:
                    n += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[to], self.popped[to] = self.goto[at << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Greedy pieces of a word; 0 if it has no complete match."""
        goto, link, popped, node, n = self.goto.get, self.link, self.popped, 0, 0
        for byte in self.prefix + word:
            while (to := goto(node << 8 | byte)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = to
        while node != 1:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return n


def token_counts(docs: DataFrame, automaton: Automaton, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_pieces (an unknown word is one piece) and n_unknown of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    schema = docs.select(key).schema
    for c in ("n_words", "n_pieces", "n_unknown"):
        schema = schema.add(c, "long")

    def run(batches):
        count = shared.value.count
        for rows, codes, words, lengths in token_chunks(batches, plain):
            pieces = np.fromiter(map(count, words), np.int64, len(words))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            n = np.bincount(doc, weights=np.maximum(pieces, 1)[codes], minlength=len(lengths))
            unknown = np.bincount(doc, weights=(pieces == 0)[codes], minlength=len(lengths))
            columns = [rows.column(key), pa.array(lengths), pa.array(n.astype(np.int64)), pa.array(unknown.astype(np.int64))]
            yield from pa.table(dict(zip(schema.names, columns))).to_batches()

    return docs.select(key, "text").mapInArrow(run, schema)
