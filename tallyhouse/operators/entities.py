"""Mentions resolved to products: id, other id, exact name, else candidates by likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, folded, match_score

LEAST_SCORE, MOST, MENTIONS = 4000, 5, 10
#: Names of best bound that are scored first.
FIRST = 64


def entity_index(parts: list[DataFrame]) -> DataFrame:
    """product_type, product_id, other_id and name of all products, and the three folded."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("product_type", "product_id", "other_id", "name", folded(F.col("product_id")).alias("folded_id"), folded(F.col("other_id")).alias("folded_other_id"), folded(F.col("name")).alias("folded_name"))


def place(types: list[str]) -> Column:
    """A product type's place in a list; those that are not in it come last."""
    at = F.array_position(F.array(*map(F.lit, types)), F.col("product_type"))
    return F.when(at > 0, at).otherwise(len(types) + 1)


def resolve(mentions: DataFrame, index: DataFrame, types: list[str], all_types: list[str] | None = None) -> DataFrame:
    """mention, product_type, product_id, matched_by, n_candidates, selected of the best kind of exact match.

    Mentions, ids and names are compared folded. An id selects the first
    product by the plan's ``types``, then by id, and comes before another id,
    which does the same, and before names. A name that several products have
    selects none: the first of them by ``all_types`` are its candidates. A column
    identifier_type of mentions, where there is one, allows one kind only:
    product_id, other_id or name; "unknown" allows all.
    """
    m = mentions.select("mention", folded(F.col("mention")).alias("folded_mention"), F.col("identifier_type") if "identifier_type" in mentions.columns else F.lit("unknown").alias("identifier_type"))
    own = index.where(F.col("product_type").isin(types))

    def by(column, kind, allowed, rank):
        here = F.col("identifier_type").isin("unknown", allowed)
        return m.where(here).join(own, F.col("folded_mention") == F.col(column)).select("mention", "product_type", "product_id", F.lit(kind).alias("matched_by"), F.lit(rank).alias("priority"))

    found = by("folded_id", "product_id", "product_id", 1).unionByName(by("folded_other_id", "other_id", "other_id", 2)).unionByName(by("folded_name", "exact_name", "name", 3)).distinct()
    best = found.groupBy("mention").agg(F.min("priority").alias("best"))
    found = found.join(best, "mention").where("priority = best")
    order = F.when(F.col("priority") == 3, place(all_types or types)).otherwise(place(types))
    w = W.partitionBy("mention")
    found = found.withColumns({"place": F.row_number().over(w.orderBy(order, "product_id")), "n_candidates": F.when(F.col("priority") == 3, F.count(F.lit(1)).over(w)).otherwise(F.lit(1).cast("bigint"))})
    most = F.when(F.col("priority") == 3, MOST).otherwise(1)
    return found.where(F.col("place") <= most).withColumn("selected", F.col("n_candidates") == 1).drop("priority", "best", "place")


def score_bound(mention: Column, name: Column) -> Column:
    """An upper bound of ``match_score`` in ten-thousandths: matching blocks cannot hold more of a character than either text has."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    characters = F.array_distinct(F.regexp_extract_all(mention, F.lit("(?s)(.)"), F.lit(1)))
    shared = F.aggregate(characters, F.lit(0), lambda n, c: n + F.least(times(mention, c), times(name, c)))
    both = F.length(mention) + F.length(name)
    return F.when(both == 0, 10_000).otherwise(F.floor(F.lit(20_000) * shared / both)).cast("int")


def bounded(mentions: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """Every mention with every name of the index that may reach ``least``: mention, the index's columns, folded_mention, bound.

    mentions: a plan's, ten at most, which become literals of the scan of the
    index; more are an error.
    """
    given = mentions.select("mention").limit(MENTIONS + 1).collect()
    if len(given) > MENTIONS:
        raise ValueError(f"more than {MENTIONS} mentions")
    texts = [r["mention"] for r in given if r["mention"] is not None]
    cells = [F.struct(F.lit(t).alias("mention"), F.lit(fold(t)).alias("folded_mention")) for t in texts]
    pairs = index.where(F.col("folded_name").isNotNull()).select("*", F.inline(F.array(*cells))) if cells else index.limit(0).select("*", F.lit("").alias("mention"), F.lit("").alias("folded_mention"))
    return pairs.withColumn("bound", score_bound(F.col("folded_mention"), F.col("folded_name"))).where(F.col("bound") >= least)


def likely(pairs: DataFrame, most: int, least: int) -> DataFrame:
    """Of ``bounded`` pairs those that can still be among the ``most`` likest of their mention.

    The names of best bound are scored first; what the last of them that counts
    reaches is then the least bound for all others. The names of one bound
    may be many, so the first are taken by id, not with their ties.
    """
    w = W.partitionBy("mention").orderBy(F.col("bound").desc(), "product_type", "product_id")
    first = pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= FIRST).drop("_n")
    scores = first.withColumn("score", match_score(F.col("folded_mention"), F.col("folded_name"))).where(F.col("score") >= least)
    # at most FIRST scores of each of ten mentions
    needed = {r["mention"]: sorted(r["scores"])[-most] for r in scores.groupBy("mention").agg(F.collect_list("score").alias("scores")).collect() if len(r["scores"]) >= most}
    enough = F.lit(least)
    for mention, score in needed.items():
        enough = F.when(F.col("mention") == F.lit(mention), score).otherwise(enough)
    return pairs.where(F.col("bound") >= enough)


def candidates(mentions: DataFrame, index: DataFrame, most: int = MOST, least: int = LEAST_SCORE, types: list[str] | None = None) -> DataFrame:
    """The likest names of each mention, never selected; equal scores by the order of ``types``, then by id.

    Only names whose bound can bring them among the likest meet the exact
    matcher, which is a Python function; the bound is one of the engine's.
    """
    pairs = likely(bounded(mentions, index, least), most, least)
    scored = pairs.withColumn("score", match_score(F.col("folded_mention"), F.col("folded_name"))).where(F.col("score") >= least)
    tie = [place(types)] if types else []
    w = W.partitionBy("mention").orderBy(F.col("score").desc(), *tie, "product_type", "product_id")
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("mention", "product_type", "product_id", "score", "position")
