"""Holdings of products: admission, coverage, constituents."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, folded
from .quality import duplicate_keys, table_hash


def coverage(products: DataFrame, observed: DataFrame) -> DataFrame:
    """Every product with its coverage state; ``unavailable`` with no holdings where none was observed.

    products: owner_type, owner_id. observed: owner_type, owner_id, coverage_state, observed_holding_count.
    """
    return products.join(observed, ["owner_type", "owner_id"], "left").select(
        "owner_type", "owner_id", F.coalesce("coverage_state", F.lit("unavailable")).alias("coverage_state"), F.coalesce("observed_holding_count", F.lit(0)).cast("bigint").alias("observed_holding_count"))


def coverage_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("owner_type", "coverage_state").agg(F.count(F.lit(1)).alias("n_owners"))


def holding_counts(holdings: DataFrame) -> DataFrame:
    """Holdings by owner, and by generation where the table has one."""
    by = [c for c in ("generation_id", "owner_type", "owner_id") if c in holdings.columns]
    return holdings.groupBy(*by).agg(F.count(F.lit(1)).alias("n_holdings"))


def violations(holdings: DataFrame, covered: DataFrame) -> DataFrame:
    """owner_type, owner_id, problem: what keeps a generation of holdings from being admitted; empty when it may be."""
    counts = holding_counts(holdings.drop("generation_id"))
    both = covered.join(counts, ["owner_type", "owner_id"], "full").withColumn("n_holdings", F.coalesce("n_holdings", F.lit(0)))
    problem = (
        F.when(F.col("coverage_state").isNull(), "holding without coverage")
        .when((F.col("coverage_state") == "unavailable") & (F.col("n_holdings") > 0), "holding of an unavailable owner")
        .when((F.col("coverage_state") == "partial_top_10") & (F.col("n_holdings") > 10), "more than ten of a partial owner")
        .when(F.coalesce(F.col("observed_holding_count"), F.lit(0)) != F.col("n_holdings"), "count differs"))
    of_owners = both.select("owner_type", "owner_id", problem.alias("problem")).where("problem is not null")
    unit = holdings.where("weight is not null and (weight < 0 or weight > 100)").select("owner_type", "owner_id", F.lit("weight out of range").alias("problem")).distinct()
    return of_owners.unionByName(unit)


@dataclass(frozen=True)
class Generation:
    """What a generation of holdings declares of itself. rows_hash: ``quality.table_hash`` of the admitted rows over all their columns."""

    generation_id: str
    source_owner: str
    source_kind: str
    direct_source_url: str
    raw_file_sha256: str
    source_as_of_date: date
    publication_date: date
    cutoff_date: date
    units: tuple[str, ...]
    n_holdings: int
    rows_hash: str
    n_quarantined: int = 0


#: Columns that say where a row comes from; holdings and coverage carry their generation's values.
LINEAGE = ("generation_id", "source_owner", "source_kind", "direct_source_url", "raw_file_sha256", "source_as_of_date", "publication_date")


def admission_problems(generation: Generation, holdings: DataFrame, observed: DataFrame, quarantined: DataFrame) -> DataFrame:
    """problem, n of what keeps a whole generation from being admitted; empty when it may be.

    holdings: owner_type, owner_id, source_row_ordinal, quantity_unit,
    market_value_currency, weight, weight_unit and LINEAGE; observed (coverage):
    owner_type, owner_id, coverage_state, observed_holding_count and LINEAGE;
    quarantined: source_row_ordinal. Nothing but the counts leaves the cluster.
    """
    def counted(df, problem):
        return df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(problem).alias("problem"), "n")

    def other_source(df):
        ok = F.lit(True)
        for c in LINEAGE:
            ok = ok & F.col(c).eqNullSafe(F.lit(getattr(generation, c)))
        return df.where(~ok)

    spark = holdings.sparkSession
    said = [
        ("no direct https address", not generation.direct_source_url.startswith("https://")),
        ("dated after the cut-off", max(generation.source_as_of_date, generation.publication_date) > generation.cutoff_date),
        ("units are not different declarations", not generation.units or len(set(generation.units)) != len(generation.units)),
    ]
    out = spark.createDataFrame([(p, 1) for p, bad in said if bad], "problem string, n bigint")
    units = F.array(*(F.concat(F.lit(f"{kind}:"), F.col(c)) for kind, c in (("quantity", "quantity_unit"), ("market_value", "market_value_currency"), ("weight", "weight_unit"))))
    declared = F.array(*map(F.lit, generation.units)) if generation.units else F.array().cast("array<string>")
    ordinals = holdings.select("source_row_ordinal", F.lit(0).alias("out")).unionByName(quarantined.select("source_row_ordinal", F.lit(1).alias("out")))
    parts = [
        counted(other_source(holdings), "holding of another source"),
        counted(other_source(observed), "coverage of another source"),
        counted(observed.where("coverage_state = 'unavailable'"), "unavailable owner with a source"),
        counted(duplicate_keys(observed, ["owner_type", "owner_id"]), "repeated owner"),
        counted(holdings.where(F.exists(F.filter(units, lambda u: u.isNotNull()), lambda u: ~F.array_contains(declared, u))), "unit that is not declared"),
        counted(ordinals.where("source_row_ordinal is null or source_row_ordinal <= 0"), "row without a number"),
        counted(duplicate_keys(ordinals, ["source_row_ordinal"]), "repeated row number"),
        counted(violations(holdings, observed), "owner's coverage is broken"),
        table_hash(holdings, sorted(holdings.columns)).where((F.col("n_rows") != generation.n_holdings) | (F.col("table_hash") != generation.rows_hash)).select(F.lit("holdings differ from those declared").alias("problem"), F.lit(1).cast("bigint").alias("n")),
        quarantined.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != generation.n_quarantined).select(F.lit("another number of quarantined rows").alias("problem"), "n"),
    ]
    for p in parts:
        out = out.unionByName(p)
    return out


def constituents(holdings: DataFrame, mention: str, most: int = 5) -> DataFrame:
    """Candidates (type, identifier, priority) for a mentioned constituent: its identifier, else its folded name; one row means resolved.

    Where there are no holdings at all the mention stands for itself, as query_text_exact.
    """
    exact = holdings.where(F.col("constituent_identifier") == F.lit(mention)).select("constituent_identifier_type", "constituent_identifier", F.lit(1).alias("priority"))
    named = holdings.where(folded(F.col("constituent_name")) == F.lit(fold(mention))).select("constituent_identifier_type", "constituent_identifier", F.lit(2).alias("priority"))
    itself = holdings.sparkSession.range(1).select(F.lit("query_text_exact").alias("constituent_identifier_type"), F.lit(mention).alias("constituent_identifier"), F.lit(3).alias("priority"))
    itself = itself.join(F.broadcast(holdings.limit(1).select(F.lit(3).alias("priority"))), "priority", "left_anti")
    both = exact.unionByName(named).unionByName(itself).groupBy("constituent_identifier_type", "constituent_identifier").agg(F.min("priority").alias("priority"))
    best = both.agg(F.min("priority").alias("best"))
    return both.join(F.broadcast(best), F.col("priority") == F.col("best")).drop("best").orderBy("constituent_identifier_type", "constituent_identifier").limit(most)
