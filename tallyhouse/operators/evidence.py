"""Evidence of an answer: direct values, derived values, summaries; and the check of claims against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import decimal_text, row_hash
from .policy import evidence_rows, records_by_id, reversed_selection  # noqa: F401  records are evidence too


def direct(values: DataFrame) -> DataFrame:
    """One row for each shown value of a tall table of metric values, with an id of its content."""
    out = values.select("product_type", "product_id", F.col("metric").alias("field"), "value", "status")
    return out.withColumn("evidence_id", row_hash(*(F.col(c) for c in ("product_type", "product_id", "field", "value", "status"))))


def derived_difference(pair: DataFrame, metric: str) -> DataFrame:
    """The evidence of a comparison of two products (``policy.compared_pairs``), with its inputs."""
    out = pair.select(F.lit(metric).alias("field"), F.array("left_id", "right_id").alias("inputs"), decimal_text(F.col("difference")).alias("value"), "direction")
    return out.withColumn("evidence_id", row_hash(F.col("field"), F.array_join("inputs", ","), F.col("value")))


def comparison(pair: DataFrame) -> DataFrame:
    """The derived evidence of a comparing plan (``policy.compared_values``): field, value, inputs, and an id of both products."""
    field = F.concat("metric", F.lit("_difference"))
    out = pair.select("product_type", "product_id", field.alias("field"), F.array("low_id", "high_id").alias("inputs"), decimal_text(F.col("difference")).alias("value"), F.lit("valid").alias("status"))
    return out.withColumn("evidence_id", F.concat(F.lit("comparison:"), row_hash(F.col("product_type"), F.col("inputs")[0], F.col("inputs")[1], F.col("field")), F.lit(":"), F.col("field")))


def summaries(counts: DataFrame, kind: str) -> DataFrame:
    """One row for each counted fact: kind, product_type, name, count."""
    names = [c for c in counts.columns if c != "product_type"]
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("count")) for c in names))
    return counts.select(F.lit(kind).alias("kind"), "product_type", F.inline(cells))


def recorded_zeros(values: DataFrame, by: list[str], top_k: int, descending: bool = False) -> DataFrame:
    """Zeros that are recorded but not comparable, among the first ``top_k`` recorded values of each group.

    The cut comes first, over all recorded values by (value, id) as one key,
    which a descending order turns round as a whole; a zero behind it is no
    part of the answer.
    """
    first = reversed_selection(values, "sort_value", descending, top_k, by)
    return first.where(~F.col("valid") & (F.col("sort_value") == 0))


def capped(ranked: DataFrame, by: list[str], cap: int, tie_break: str = "product_id") -> DataFrame:
    """The first ``cap`` ranked rows of each partition, with position, and at_boundary: whether the cut parts the row's tie group."""
    rows = evidence_rows(ranked, by, cap, tie_break)
    last = F.max("position").over(W.partitionBy(*by, "rank"))
    first = F.min("position").over(W.partitionBy(*by, "rank"))
    return rows.withColumn("at_boundary", F.col("tie_count") > last - first + 1)


def point_lookup(evidence: DataFrame, ids: list[str], most: int = 50) -> DataFrame:
    """Evidence by id; the ids are a plan's, at most fifty."""
    if not 1 <= len(set(ids)) <= most:
        raise ValueError(f"1 to {most} ids are needed")
    return evidence.where(F.col("evidence_id").isin(sorted(set(ids))))


#: Columns of claims and of evidence that a typed claim has to share.
CLAIMED = ("product_type", "product_id", "field", "value", "groups")


def claim_problems(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id and problem of every claim that its evidence does not carry; empty for a verified answer.

    claims: claim_id, kind ('numeric', 'candidate', 'limitation' or 'text'),
    evidence_ids (array), product_type, product_id, field, value (text), groups
    (array). evidence: evidence_id, product_type, product_id, field, value, groups.

    A numeric claim needs evidence; every id it names has to be there; a
    numeric claim, or one that names a field, agrees with one of its evidence
    rows in product, field, value and groups (a claim without type or groups
    takes any type, and no groups only where the evidence has none); a candidate is
    the product of all its evidence. Ids join with evidence once: claims are
    exploded by id and summed up again by claim.
    """
    named = claims.withColumn("_id", F.explode_outer("evidence_ids"))
    e = evidence.select(F.col("evidence_id").alias("_evidence"), *(F.col(c).alias(f"_{c}") for c in CLAIMED))
    both = named.join(e, F.col("_id") == F.col("_evidence"), "left")
    known = F.col("_evidence").isNotNull()
    same = known
    same &= F.col("product_type").isNull() | F.col("product_type").eqNullSafe(F.col("_product_type"))
    for c in ("product_id", "field", "value"):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    none = F.array().cast("array<string>")
    same &= F.coalesce("groups", none) == F.coalesce("_groups", none)
    own = known & F.col("product_type").eqNullSafe(F.col("_product_type")) & F.col("product_id").eqNullSafe(F.col("_product_id"))
    of = both.groupBy("claim_id", "kind").agg(
        F.max(F.col("field").isNotNull()).alias("has_field"), F.count("_id").alias("n_ids"), F.count_if(F.col("_id").isNotNull() & ~known).alias("n_unknown"),
        F.max(same).alias("agrees"), F.min(own).alias("all_own"))
    numeric, candidate = F.col("kind") == "numeric", F.col("kind") == "candidate"
    problem = (
        F.when(numeric & (F.col("n_ids") == 0), "numeric claim without evidence").when(F.col("n_unknown") > 0, "unknown evidence")
        .when(candidate & ((F.col("n_ids") == 0) | ~F.col("all_own")), "evidence of another product").when((numeric | F.col("has_field")) & ~F.col("agrees"), "differs from its evidence"))
    return of.select("claim_id", problem.alias("problem")).where("problem is not null")


def missing_limitations(limitations: DataFrame, claims: DataFrame) -> DataFrame:
    """The limitations (limitation, detail) of an answer that no limitation claim says; empty for a complete answer."""
    said = claims.where("kind = 'limitation'").select(F.col("value").alias("_said")).distinct()
    return limitations.join(said, F.concat_ws(": ", "limitation", "detail") == F.col("_said"), "left_anti")


def unsupported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (claim_id, evidence_id, value) that no evidence row carries with that value; empty for a verified answer."""
    e = evidence.select(F.col("evidence_id").alias("_id"), F.col("value").alias("_value"))
    return claims.join(e, (F.col("evidence_id") == F.col("_id")) & F.col("value").eqNullSafe(F.col("_value")), "left_anti")


def shown(value: Column, unit: str | None) -> Column:
    """A decimal for readers: no trailing zeros, thousands marked, the unit after it."""
    t = decimal_text(value)
    whole, rest = F.regexp_extract(t, r"^(-?[0-9]+)", 1), F.regexp_extract(t, r"(\.[0-9]+)\z", 1)
    return F.concat(F.regexp_replace(whole, r"(?<=[0-9])(?=([0-9]{3})+\z)", ","), rest, F.lit({"percent": "%", "day": " days"}.get(unit, "")))
