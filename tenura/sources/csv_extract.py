"""CSV extracts read by each file's own header, with the rows that do not fit kept aside.

Files of one extract may list their columns in another order, or add and miss some.  Files
are grouped by header, every group is read with a schema of its own names, and the groups
are joined by name.  A row with more or fewer fields than its header is a reject: it comes
back whole, with its file and the header it was held against, instead of being dropped.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_RECORD = "_reject"
_HEADERS_AT_ONCE = 8


class CsvExtract(NamedTuple):
    rows: DataFrame         # by name, text, blank and NULL spellings as NULL, and ``source_file``
    rejects: DataFrame      # source_file, header, first_value, record


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def headers(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, tuple[str, ...]]:
    """file -> its column names, lower-cased; empty files are left out.

    Spark lists the files; a header is read by a job that stops at the first line."""
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())

    def header(file: str) -> tuple[str, ...]:
        names = tuple(c.strip().lower() for c in _reader(spark, multi_line).option("header", True).csv(file).columns)
        if len(set(names)) < len(names):
            raise ValueError(f"{file}: a column name stands twice in {', '.join(names)}")
        return names

    with ThreadPoolExecutor(_HEADERS_AT_ONCE) as pool:
        return {f: h for f, h in zip(files, pool.map(header, files), strict=True) if h}


def read_csv_extract(spark: SparkSession, path: str, col_map: dict[str, str] | None = None,
                     timestamp_cols: tuple[str, ...] = (), multi_line: bool = True) -> CsvExtract:
    """All files under ``path`` (a file, a folder or a glob) by header name.

    ``multi_line``: a quoted value may hold line breaks; a file is then one task.  Extracts
    known to have none can pass False, and large files are split.  A column that a file does
    not have is NULL in its rows.  '', 'NULL' and 'null' are NULL; unparseable timestamps
    are NULL; ``col_map`` renames header names.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers(spark, path, multi_line).items():
        groups.setdefault(names, []).append(file)
    rows, rejects = [], []
    for names, files in groups.items():
        schema = StructType([StructField(c, StringType()) for c in (*names, _RECORD)])
        raw = (_reader(spark, multi_line).option("header", True).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", _RECORD).schema(schema).csv(files)
               .withColumn("source_file", F.col("_metadata.file_path")))
        # Spark refuses to judge a row by the reject column alone: a condition that always holds names another
        raw = raw.where(F.coalesce(F.length(names[0]), F.lit(0)) >= 0)
        good = raw.where(F.col(_RECORD).isNull()).select("source_file", *[
            F.when(F.col(c).isin("", "NULL", "null"), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) for c in names])
        rows.append(good)
        rejects.append(raw.where(F.col(_RECORD).isNotNull()).select(
            "source_file", F.lit(",".join(names)).alias("header"), F.col(names[0]).alias("first_value"),
            F.col(_RECORD).alias("record")))
    if not rows:
        rows = [spark.createDataFrame([], "source_file string")]
        rejects = [spark.createDataFrame([], "source_file string, header string, first_value string, record string")]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    if col_map:
        out = out.withColumnsRenamed({k.lower(): v for k, v in col_map.items()})
    for c in timestamp_cols:
        out = out.withColumn(c, F.try_to_timestamp(F.col(c)))
    return CsvExtract(out, reduce(lambda a, b: a.unionByName(b), rejects))


def reject_counts(extract: CsvExtract) -> DataFrame:
    """(source_file, rows_read, rows_rejected) of every file with a row: the load report."""
    good = extract.rows.select("source_file", F.lit(0).alias("bad"))
    bad = extract.rejects.select("source_file", F.lit(1).alias("bad"))
    return good.unionByName(bad).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_read"), F.sum("bad").cast("bigint").alias("rows_rejected"))
