"""Whole-table order without a one-task window: positions, breaks of an order, and a hash that keeps it.

Rows are dealt to ranges of the order and sorted within them; what crosses the
ranges is one small row for each: a count (prefix sums give positions), its
last key (the edge that the next range's first row is compared with), or a
(value, multiplier) pair of a hash. Rows of equal order are dealt by their place in the
input too, so that one value with most rows is no single range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import row_hash
from ..sources.staging import staged

#: The four largest primes below 2^31 and a multiplier for each; a row gives 31 bits to each.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
MULTIPLIERS = (1000003, 1299709, 15485863, 179424673)


def file_order(df: DataFrame) -> DataFrame:
    """A Parquet table with file_path and row_index, the order of its rows on disk."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def _dealt(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` with range and place (both from 0), staged; ranges follow the order, places the order within a range."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_rows = df.withColumn("_from", F.monotonically_increasing_id()).repartitionByRange(*by, "_from").sortWithinPartitions(*by, "_from").drop("_from")
    at = F.col("_at")
    # the engine's own id is the partition's number and the row's number within it
    numbered = staged(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    return numbered.withColumns({"_range": F.shiftright(at, 33).cast("int"), "_place": at.bitwiseAND((1 << 33) - 1)}).drop("_at")


def _by_range(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``df`` joined with one small row a range."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), "_range", "left")


def _offsets(df: DataFrame, rows: list[tuple[int, int]]) -> DataFrame:
    """``df`` joined with _before of each range; an Arrow table, as one of rows starts another Python daemon with workers in every executor."""
    ranges, before = [r for r, _ in rows], [n for _, n in rows]
    table = pa.table({"_range": pa.array(ranges, pa.int32()), "_before": pa.array(before, pa.int64())})
    return df.join(F.broadcast(df.sparkSession.createDataFrame(table)), "_range", "left")


def positions(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """``df`` with each row's position from 1 in the whole table's order; rows of equal order in any order."""
    dealt = _dealt(df, order)
    before, offsets = 0, []
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():  # one row a task of the sort
        offsets.append((r["_range"], before))
        before += r["count"]
    placed = _offsets(dealt, offsets)
    return placed.withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def running_sums(df: DataFrame, order: list[str | Column], value: str, name: str = "so_far") -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row in the whole table's order; a null adds nothing."""
    dealt = _dealt(df, order)
    before, offsets = 0, []
    for r in dealt.groupBy("_range").agg(F.coalesce(F.sum(F.col(value).cast("long")), F.lit(0)).alias("s")).orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["s"]
    own = F.sum(F.coalesce(F.col(value).cast("long"), F.lit(0))).over(W.partitionBy("_range").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow))
    return _offsets(dealt, offsets).withColumn(name, F.col("_before") + own).drop("_range", "_place", "_before")


def order_breaks(df: DataFrame, order: list[str | Column], key: list[str]) -> DataFrame:
    """Rows whose key is less than that of the row before them in the whole table, with both keys (structs, nulls first); empty for a sorted table."""
    dealt = _dealt(df.withColumn("key", F.struct(*key)), order)
    last, edges = None, []
    for r in dealt.groupBy("_range").agg(F.max_by("key", "_place").alias("last")).orderBy("_range").collect():
        edges.append((r["_range"], last))
        last = r["last"]
    kind = dealt.schema["key"].dataType.simpleString()
    edged = _by_range(dealt, edges, f"_range int, _edge {kind}")
    inside = F.lag("key").over(W.partitionBy("_range").orderBy("_place"))
    before = edged.withColumn("before", F.when(F.col("_place") == 0, F.col("_edge")).otherwise(inside))
    return before.where("before is not null and key < before").drop("_range", "_place", "_edge")


def powers(n: int) -> np.ndarray:
    """multiplier^(n-1) ... multiplier^0 of each modulus."""
    out = np.empty((len(MODULI), n), np.int64)
    for k, (m, b) in enumerate(zip(MODULI, MULTIPLIERS)):
        x = 1
        for i in range(n - 1, -1, -1):
            out[k, i] = x
            x = x * b % m
    return out


def joined(a: tuple[int, ...], b: tuple[int, ...], b_rows: int) -> tuple[int, ...]:
    """The hash of a table from the hashes of its first and second part. Associative; the order of the parts counts."""
    return tuple((x * pow(p, b_rows, m) + y) % m for x, y, m, p in zip(a, b, MODULI, MULTIPLIERS))


def part_hashes(rows: DataFrame) -> list[tuple[int, int, tuple[int, ...]]]:
    """(task, rows, hash) of each task's rows of ``rows`` (h: hexadecimal), in their order."""
    def run(batches):
        n, value, known = 0, (0,) * len(MODULI), {}
        for batch in batches:
            text = "".join(h[: 8 * len(MODULI)] for h in batch.column("h").to_pylist())
            parts = (np.frombuffer(bytes.fromhex(text), ">u4").astype(np.int64) & 0x7FFFFFFF).reshape(-1, len(MODULI))
            if len(parts) not in known:
                known[len(parts)] = powers(len(parts))
            own = tuple(int((parts[:, k] * p % m).sum() % m) for k, (p, m) in enumerate(zip(known[len(parts)], MODULI)))
            value, n = joined(value, own, len(parts)), n + len(parts)
        if n:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [n], "value": pa.array([list(value)], pa.list_(pa.int64()))})

    found = rows.select("h").mapInArrow(run, "task int, n long, value array<long>").collect()
    return sorted((r["task"], r["n"], tuple(r["value"])) for r in found)


def ordered_hash(df: DataFrame, order: list[str | Column], columns: list[str]) -> DataFrame:
    """n_rows and table_hash of a table in an order: two rows that change places change it, another partitioning does not.

    Tables in parts need no second reading: ``joined`` gives the whole's hash. Rows of equal order count in the order of their own hashes.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumns({"h": row_hash(*(F.col(c) for c in columns)), "_from": F.monotonically_increasing_id()})
    keys = [*by, "h", "_from"]
    n, value = 0, (0,) * len(MODULI)
    for _, more, own in part_hashes(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)):
        n, value = n + more, joined(value, own, more)
    return df.sparkSession.createDataFrame([(n, "".join(f"{v:08x}" for v in value))], "n_rows long, table_hash string")


def sql_ordered_hash(rows: str) -> str:
    """The same in DuckDB: ``rows`` selects h and place, unique places in the order."""
    folds = [
        f"printf('%08x', list_reduce(list(cast(('0x' || substr(h, {1 + 8 * k}, 8)) as bigint) & 2147483647 order by place), lambda a, x: (a * {b} + x) % {m}, cast(0 as bigint)))"
        for k, (m, b) in enumerate(zip(MODULI, MULTIPLIERS))
    ]
    return f"select count(*) as n_rows, {' || '.join(folds)} as table_hash from ({rows})"
