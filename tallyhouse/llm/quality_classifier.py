"""Operator 10: a document's quality from its perplexity under a model of trusted text.

Trusted are documents whose labels all say quality 1 and toxic 0. A bounded
sample of them (``learn_documents``, the first ones by hash) teaches the
Kneser-Ney model (``order`` 2 unless given: 3 rejects no more of the labelled
bad documents, as the README shows); the count joins of its scoring run by shard. All trusted
documents that are not candidates for learning give the quantile of log10
perplexity of each language, beyond which a document is rejected; a language
with under ``least`` of them, or none, takes the quantile of all. Without any
such document nothing is rejected.

Defined cases: a null or empty text has one token, its end, and is rejected
only if that alone is beyond the threshold; a null key has no label; repeated
rows are judged each; labels repeated for a key must all be good to trust it,
where a null beside another says nothing. A text at its threshold is kept; equal hashes in the choice of the learning part
go by key; an empty table gives no rows; other columns, whatever their names,
are ignored by the verdicts and kept by ``accepted``; a very long text is one
row of one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kneser_ney import score, train
from .shared import keyed, shards, written

QUANTILE, LEAST, LEARN_DOCUMENTS = 0.995, 50, 20_000
#: Tokens that a task works on at once: memory, not the input.
TOKENS = 100_000
#: Files of the model at most; the documents that teach it are bounded, and every chunk of texts meets every file.
FILES = 64


def quality_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", quantile: float = QUANTILE, least: int = LEAST, learn_documents: int = LEARN_DOCUMENTS, order: int = 2) -> DataFrame:
    """key, lang, n_tokens, perplexity, threshold (of perplexity; null: none) and kept for each row of ``docs``."""
    docs = docs.select(F.col(key).alias(key), "lang", "text")
    trusted = (
        labels.where(F.col(key).isNotNull()).groupBy(key)
        .agg((F.coalesce(F.min("quality"), F.lit(0)) == 1).alias("good"), (F.coalesce(F.max("toxic"), F.lit(0)) == 0).alias("clean"))
        .where("good and clean").select(key, (F.pmod(F.xxhash64(key), F.lit(10)) < 7).alias("learn"))
    )
    learn = written(trusted.where("learn").orderBy(F.xxhash64(F.col(key), F.lit(1)), key).limit(learn_documents).select(key), "learn")
    # at most learn_documents keys, so the side is safe to broadcast
    meta = train(docs.join(F.broadcast(learn), key, "left_semi"), order, min(shards(docs.sparkSession), FILES), TOKENS)
    scores = written(score(docs, meta, TOKENS).select(key, "lang", "n_tokens", (-F.col("score") / F.col("n_tokens")).alias("bits")), "quality-scores")
    held = scores.join(trusted.where("not learn").select(key), key, "left_semi")
    by_lang = held.groupBy("lang").agg(F.percentile_approx("bits", quantile, 100_000).alias("own"), F.count(F.lit(1)).alias("n"))
    pooled = held.agg(F.percentile_approx("bits", quantile, 100_000).alias("own")).first()["own"]
    at = F.when(F.col("n") >= least, F.col("own")).otherwise(F.lit(pooled).cast("double"))
    thresholds = by_lang.select(F.col("lang").alias("of"), at.alias("at"))
    return (
        scores.join(thresholds, F.col("lang").eqNullSafe(F.col("of")), "left")
        .withColumn("at", F.coalesce("at", F.lit(pooled).cast("double")))
        .select(key, "lang", "n_tokens", F.pow(F.lit(10.0), "bits").alias("perplexity"), F.pow(F.lit(10.0), "at").alias("threshold"), F.coalesce(F.col("bits") <= F.col("at"), F.lit(True)).alias("kept"))
    )


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` but for the keys of which every row is rejected; rows with a null key stay."""
    verdicts = quality_verdicts(docs, labels, key, **options)
    gone = written(verdicts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("kept").alias("kept")).where("not kept").select(key), "rejected")
    return keyed(docs, gone, key, "left_anti")
