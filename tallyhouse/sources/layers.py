"""Bronze rows and cells of raw text tables, file checks, and the sinks and scans of the layers."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.parse import excel_letters, row_hash

#: Bytes of a file that a task holds at once.
CHUNK = 8 << 20


def source_columns(spark: SparkSession, schemas: dict[str, list[str]]) -> DataFrame:
    """bronze_source_column: source_table, column_number, column_letter, column_name of all declared columns."""
    rows = [(t, i, excel_letters(i), c) for t, cs in sorted(schemas.items()) for i, c in enumerate(cs, 1)]
    return spark.createDataFrame(rows, "source_table string, column_number bigint, column_letter string, column_name string")


def header_problems(df: DataFrame, declared: list[str]) -> list[str]:
    """What is wrong with a table's columns; empty if they are the declared ones in order."""
    out = [f"column {i}: {a!r}, not {b!r}" for i, (a, b) in enumerate(zip(df.columns, declared), 1) if a != b]
    if len(df.columns) != len(declared):
        out.append(f"{len(df.columns)} columns, not {len(declared)}")
    return out


def source_rows(df: DataFrame, table: str, key: list[str], columns: list[str], loaded: datetime) -> DataFrame:
    """bronze_source_row: key, the row's JSON, its hash, and when it was loaded."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.lit(table).alias("source_table"), *key, F.to_json(F.array(*texts)).alias("row_json"), row_hash(*texts).alias("payload_sha256"), F.lit(loaded).alias("loaded_at"))


def source_cells(df: DataFrame, table: str, key: list[str], columns: list[str]) -> DataFrame:
    """bronze_source_cell: one row a cell, with the column's number, letters and name."""
    cells = F.array(*(F.struct(F.lit(i).cast("bigint").alias("column_number"), F.lit(excel_letters(i)).alias("column_letter"), F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("raw_value")) for i, c in enumerate(columns, 1)))
    return df.select(F.lit(table).alias("source_table"), *key, F.inline(cells))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha-256 of source files of any size.

    Files are listed without their contents; tasks read them in chunks, as a
    digest goes through a file from its start; empty files are not listed, which for a source is as good as missing. The files' store has to be one
    that ``pyarrow.fs`` opens: local and mounted folders, HDFS, S3, GCS.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    # the largest files first, each to a task of its own as far as there are tasks
    dealt = files.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("length").desc(), "path")
    return dealt.mapInArrow(_digests, "path string, length long, sha256 string")


def _digests(batches):
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            # Spark names files without escapes
            store, at = (pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith("file:") else pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
            with store.open_input_stream(at) as f:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])


def source_problems(files: DataFrame, manifest: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """name and problem of files that are not as a manifest says; empty for a verified set.

    files: name, length, sha256. manifest: name, size_bytes, sha256 and, for
    data files, expected_rows and expected_columns. counts: name, n_rows and n_columns of
    the data files that were read. A file has one problem, the first of: missing,
    unexpected, size, checksum, not read, rows, columns.
    """
    have = files.select("name", F.col("length").alias("_length"), F.col("sha256").alias("_sha256"))
    both = manifest.join(have, "name", "full")
    problem = F.when(F.col("_length").isNull(), "missing").when(F.col("size_bytes").isNull(), "unexpected").when(F.col("size_bytes") != F.col("_length"), "size differs").when(F.lower("sha256") != F.col("_sha256"), "checksum differs")
    if counts is not None:
        both = both.join(counts.select("name", "n_rows", "n_columns"), "name", "left")
        expected = F.col("expected_rows").isNotNull()
        problem = problem.when(expected & F.col("n_rows").isNull(), "not read").when(expected & (F.col("expected_rows") != F.col("n_rows")), "row count differs").when(F.col("expected_columns") != F.col("n_columns"), "column count differs")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def named_files(digests: DataFrame, root: str) -> DataFrame:
    """``digests`` with the files' names below ``root`` in place of their paths."""
    below = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace("path", r"^file:/+", "/")
    return digests.select(F.when(F.startswith(path, F.lit(below)), F.substr(path, F.lit(len(below) + 1))).otherwise(path).alias("name"), "length", "sha256")


def write_sorted(df: DataFrame, path: str, sort_key: list[str], partitions: int | None = None) -> None:
    """Parquet (zstd) in the order of a key, range-partitioned so that files and row groups have narrow statistics."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *sort_key).sortWithinPartitions(*sort_key).write.option("compression", "zstd").mode("overwrite").parquet(path)


def read_declared(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def publish(df: DataFrame, root: str, name: str, version: str, sort_key: list[str]) -> None:
    """A new version of a table beside the old ones; readers switch when the view is replaced after the write."""
    path = f"{root}/{name}/version={version}"
    write_sorted(df, path, sort_key)
    df.sparkSession.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
