"""Helpers of the training-data operators: shared folder, written tables, token batches.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D.
``bytes.split()`` and Arrow's ``ascii_split_whitespace`` split on exactly these
six ASCII characters, so the words of a text are ``text.encode().split()``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Tokens that a task works on at once; bounds its memory, not the input.
CHUNK_TOKENS = 500_000
#: Bytes of text that are split into words at once.
SLICE_BYTES = 1 << 20
#: Keys that are broadcast at most; beyond, the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Bytes of an Arrow batch that goes to a Python worker; bounds what the JVM and the worker hold of it, not the input.
BATCH_BYTES = 1 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; with a local master, a temporary one where it is unset (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyhouse.shared.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyhouse-")
        spark.conf.set("tallyhouse.shared.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    The tables stay there, as results are lazy and read them later; the folder
    is the job's, to be removed with it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session cuts Arrow batches at BATCH_BYTES; a limit that it was given stays.

    By its default (10,000 rows, 64 MB) a batch is all texts of a task, which
    the JVM holds as vectors and again as a stream, beside its heap. Results
    do not depend on it. It holds for the session, as results are lazy and
    planned later.
    """
    if not spark.conf.get(ARROW_BYTES, None):
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def keyed(docs: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of whole documents with a table of distinct keys, broadcast only if it is small."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, how)


def local_path(url: str) -> str:
    """A path that Python can open for a URL of the shared folder, which has to be mounted on every machine."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"memory-mapped files need a mounted shared folder as spark.checkpoint.dir, not {url}")
    return url


def shards(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_words(text: Column) -> Column:
    """Words of a text as bigint; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """One 64-bit hash of two, vectorised (multiply, fold, multiply)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def hash_words(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words))


def plain(texts: pa.Array) -> pa.Array:
    """The words of each text; a text's ends may add an empty one. Arrow's white space in ASCII is these six characters too."""
    return pc.ascii_split_whitespace(texts)


def lowered(texts: pa.Array) -> pa.Array:
    """The words of each text with A-Z in lower case; a text's ends may add an empty one."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def text_slices(batch: pa.RecordBatch):
    """Consecutive rows with about SLICE_BYTES of column ``text``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(edges, edges[1:]):
        if stop > start:
            yield batch.slice(start, stop - start)


def split_words(texts: pa.Array, split) -> tuple[pa.Array, np.ndarray]:
    """All words (binary), one text after another, and how many each text has."""
    lists = split(texts)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    words = words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary())
    some = pc.greater(pc.binary_length(words), 0)
    if pc.all(some).as_py() is False:
        until = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
        ends = np.cumsum(lengths)
        words, lengths = words.filter(some), until[ends] - until[ends - lengths]
    return words, lengths


def token_chunks(batches, split, extra: int = 0, most: int = CHUNK_TOKENS):
    """(rows, codes, words, lengths) of consecutive rows with about ``most`` tokens.

    rows: the input's record batch for the chunk; ``split`` gives the words of
    an array of texts (``plain`` or ``lowered``), to which ``extra`` is added in
    the lengths only; codes: each token's index in ``words``, the chunk's
    distinct tokens (bytes). Words become Python objects only once a chunk.
    """
    def done(parts):
        rows, words, lengths = zip(*parts)
        d = pa.concat_arrays(words).dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.Table.from_batches(rows).combine_chunks(), codes, d.dictionary.to_numpy(zero_copy_only=False).tolist(), np.concatenate(lengths) + extra

    parts, n = [], 0
    for batch in batches:
        for piece in text_slices(batch):
            words, lengths = split_words(piece.column("text"), split)
            ends = np.append(0, np.cumsum(lengths))
            start = 0
            while start < piece.num_rows:
                stop = min(int(np.searchsorted(ends[1:], ends[start] + most - n)) + 1, piece.num_rows)
                here = int(ends[stop] - ends[start])
                parts.append((piece.slice(start, stop - start), words.slice(int(ends[start]), here), lengths[start:stop]))
                n, start = n + here, stop
                if n >= most:
                    yield done(parts)
                    parts, n = [], 0
    if parts:
        yield done(parts)


def replace_file(path: str, write) -> None:
    """Write a file under another name, then move it into place: a task that runs twice leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        write(f)
    os.replace(tmp, path)
