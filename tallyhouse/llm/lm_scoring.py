"""Operator 2: language-model scores of whole texts.

The model is the interpolated modified Kneser-Ney model of ``kneser_ney``. Its
order is a parameter, two unless given: the distinct trigrams of a corpus are
most of its words, and their shuffle and arrays do not fit the disk of four
times the input (figures in the README).

Defined cases: a null or empty text scores its end alone; a null key is not
held out; repeated rows are scored each, and learned from each; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kneser_ney import corpus_shards, score, train


#: Tokens counted at once; more of them combine to fewer n-grams in the shuffle of a whole corpus.
COUNT_TOKENS = 1_000_000


def held_out_column(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves the remainder 2 by 7; false for null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def lm_scores(docs: DataFrame, key: str = "doc_id", order: int = 2) -> DataFrame:
    """Each text's score by a model of the texts that are not held out."""
    docs = docs.select(F.col(key).alias(key), held_out_column(key).alias("held_out"), "text")
    learned = docs.where(~F.col("held_out"))
    meta = train(learned, order, corpus_shards(learned), COUNT_TOKENS)
    return score(docs, meta)
