"""Two tables compared range by range: only the ranges of keys that differ are opened.

Bounds are key tuples from a sample by hash of the first table's keys; they part the work and settle no row. A row
finds its range by the bin of its first key column; a row of a bin in which
ranges meet finds it by an equality join on the bin, plus the tuple bounds. The
ranges are a few thousand at most, so that side is broadcast.
Each range of both tables is summed up to a count and a hash that does not
depend on order; where the two agree, nothing more is read. Where most ranges
differ, the whole tables are compared. Keys need not be unique.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import difference

BINS = 16_384
#: Keys sampled for each bound; intervals of the first key column that reach the scan as filters.
SAMPLED, INTERVALS = 20, 64


def on_line(c: Column, kind: T.DataType) -> Column:
    """A column as a number that keeps its order (a text by its first six bytes); null: the least."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        number = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(c.cast("timestamp")).cast("double")
    else:
        number = c.cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def bounds(df: DataFrame, key: list[str], ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 ascending keys that part the distinct keys of ``df`` into about equal shares."""
    found = df.select(*key).where(F.col(key[0]).isNotNull())
    distinct = found.agg(F.approx_count_distinct(F.struct(*key))).first()[0]
    step = max(1, distinct // (SAMPLED * ranges))
    # distinct keys, so that a key with most rows is one row of the sample
    rows = found.where(F.pmod(F.xxhash64(*key), F.lit(step)) == 0).distinct().orderBy(*key).collect()
    return [tuple(rows[len(rows) * i // ranges]) for i in sorted({len(rows) * i // ranges: i for i in range(1, ranges)}.values())] if rows else []


def in_ranges(df: DataFrame, key: list[str], at: list[tuple]) -> DataFrame:
    """``df`` with range: how many of the bounds are not above the row's key."""
    if not at:
        return df.withColumn("range", F.lit(0))
    spark, kind = df.sparkSession, df.schema[key[0]].dataType
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in key])
    line = on_line(F.col(f"bound.{key[0]}"), kind)
    marks = spark.createDataFrame(list(enumerate(at)), T.StructType([T.StructField("i", T.IntegerType()), T.StructField("bound", schema)])).select("i", line.alias("x"))
    span = marks.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    width = max((span["b"] - span["a"]) / BINS, 1e-300)
    bin_of = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((c - F.lit(span["a"])) / F.lit(width)))).cast("int")
    bins = [r["bin"] for r in marks.select("i", bin_of(F.col("x")).alias("bin")).orderBy("i").collect()]
    # a bin without a bound lies in one range; only rows of the other bins are compared with bounds
    within = set(bins)
    settled = F.split(F.lit(",".join("-1" if k in within else str(bisect_left(bins, k)) for k in range(BINS))), ",").cast("array<int>")
    parts = [(k, i, at[i - 1] if i else None, at[i] if i < len(at) else None) for k in sorted(within) for i in range(bisect_left(bins, k), bisect_right(bins, k) + 1)]
    ends = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("_found", T.IntegerType()), T.StructField("low", schema), T.StructField("high", schema)])
    table = F.broadcast(spark.createDataFrame(parts, ends))
    own = F.struct(*key)
    rows = df.withColumn("_bin", bin_of(on_line(F.col(key[0]), kind))).withColumn("range", F.element_at(settled, F.col("_bin") + 1)).withColumn("_bin", F.when(F.col("range") < 0, F.col("_bin")))
    inside = (F.col("_bin") == F.col("bin")) & (F.col("low").isNull() | (own >= F.col("low"))) & (F.col("high").isNull() | (own < F.col("high")))
    return rows.join(table, inside, "left").withColumn("range", F.coalesce("_found", "range")).drop("_bin", "bin", "_found", "low", "high")


def range_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """range, n and four sums of the rows' hashes: the halves of two 64-bit ones, of the columns forth and back."""
    # a null leaves the engine's hash as it is, so that whether there is one goes along
    values = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    hashes = [F.xxhash64(*values), F.xxhash64(F.lit(1), *values[::-1])]
    halves = [half for h in hashes for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    parts = [F.sum(half).alias(f"s{i}") for i, half in enumerate(halves)]
    return df.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *parts)


def differing(a: DataFrame, b: DataFrame, columns: list[str]) -> list[int]:
    """The ranges whose rows are not the same, as multisets, in two tables with ranges; no more than there are bounds."""
    right = [F.col(c).alias(f"_{c}") for c in ("range", "n", "s0", "s1", "s2", "s3")]
    both = range_sums(a, columns).join(range_sums(b, columns).select(*right), F.col("range") == F.col("_range"), "full")
    same = F.lit(True)
    for c in ("n", "s0", "s1", "s2", "s3"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return sorted(r[0] for r in both.where(~same).select(F.coalesce("range", "_range")).collect())


def _reaches(key: str, at: list[tuple], which: list[int]) -> Column:
    """A filter on the first key column that holds for every row of the ranges, simple enough for the scan."""
    runs: list[list[int]] = []
    for i in which:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    if len(runs) > INTERVALS:
        runs = [[which[0], which[-1]]]
    out = F.lit(False)
    for low, high in runs:
        c = F.col(key)
        one = F.lit(True) if low == 0 else c >= F.lit(at[low - 1][0])
        if high < len(at):
            one = one & ((c <= F.lit(at[high][0])) if low else (c <= F.lit(at[high][0])) | c.isNull())
        out = out | one
    return out


def changed_rows(a: DataFrame, b: DataFrame, key: list[str], ranges: int = 256) -> DataFrame:
    """Rows, with repeats, that only one of two tables of the same columns has: all columns and only_in ('left', 'right')."""
    columns = a.columns
    b = b.select(*columns)
    at = bounds(a, key, ranges)
    ranged = [in_ranges(x, key, at) for x in (a, b)]
    which = differing(*ranged, columns)
    if 2 * len(which) > len(at) + 1:  # to open most ranges costs more than to compare all
        return difference(a, b)
    opened = [in_ranges(x.where(_reaches(key[0], at, which)), key, at).where(F.col("range").isin(which)).select(*columns) if which else x.limit(0) for x in (a, b)]
    return difference(*opened)
