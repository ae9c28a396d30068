"""Sinks, layout and materialisation.

Open-source Parquet has no ZORDER/CLUSTER BY, so co-location is done at write
time: range-partition on the keys (sampled boundaries, no global sort on one
task) and sort within each partition, so Parquet row-group min/max statistics
prune reads on those keys.  With several columns to filter by, ``z_ordered_write``
interleaves the bits of their ranks, so a filter on any of them prunes.  ``bucketBy`` is offered for tables that are joined
on a key again and again, so later sort-merge joins skip the shuffle.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Z_SAMPLE = 20_000          # rows that the driver sees to place the rank boundaries


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """bronze/search sink — overwrite (first batch / full refresh) or append.

    One job writes all partitions in parallel; Spark's commit protocol makes
    the output appear atomically per job and retries failed tasks.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def cluster_write(df: DataFrame, keys: list[str], path: str, n_files: int | None = None,
                  mode: str = "overwrite") -> None:
    """K1: co-locate rows by ``keys`` (range partitioning + sort within partitions)."""
    n = n_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
       .write.mode(mode).parquet(path))


def rank_bounds(df: DataFrame, cols: list[str], bits: int, sample: int = Z_SAMPLE) -> dict[str, list]:
    """Up to 2**bits - 1 boundaries per column, evenly spaced among a random sample of at most
    ``sample`` rows (a top-k: each task sends that many at most)."""
    rows = df.select(*cols).orderBy(F.rand(7)).limit(sample).collect()
    out = {}
    for c in cols:
        seen = sorted(r[c] for r in rows if r[c] is not None)
        cuts = {seen[len(seen) * i >> bits] for i in range(1, 1 << bits)} if seen else set()
        out[c] = sorted(cuts)
    return out


def _rank(c: Column, bounds: list) -> Column:
    """How many of the sorted bounds are <= c, by bisection; NULL is 0."""
    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(bounds[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))
    return F.when(c.isNull(), F.lit(0)).otherwise(between(0, len(bounds))) if bounds else F.lit(0)


def z_key(bounds: dict[str, list], bits: int) -> Column:
    """The interleaved bits of the columns' ranks; the first column gives the highest bit."""
    n = len(bounds)
    if n * bits > 62:
        raise ValueError(f"{n} columns of {bits} bits do not fit a long")
    key = F.lit(0).cast("long")
    for j, (c, b) in enumerate(bounds.items()):
        rank = _rank(F.col(c), b).cast("long")
        for i in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, i).bitwiseAND(F.lit(1).cast("long")), i * n + n - 1 - j))
    return key


def z_ordered_write(df: DataFrame, cols: list[str], path: str, n_files: int | None = None, bits: int = 6,
                    mode: str = "overwrite") -> None:
    """K1 for several columns: files are ranges of the Z-order of the columns' sampled ranks, so a
    range of any of the columns touches only some files.  Rows of one Z cell are cut by the
    columns themselves, so a cell that holds very many rows is several files."""
    n = n_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__z", z_key(rank_bounds(df, cols, bits), bits))
    (keyed.repartitionByRange(n, "__z", *cols).sortWithinPartitions("__z", *cols).drop("__z")
        .write.mode(mode).parquet(path))


def bucketed_table(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "overwrite",
                   path: str | None = None) -> None:
    """K1 (join layout): a bucketed, sorted catalog table on the join keys.

    Two tables bucketed the same way on the join key join without a shuffle.
    ``path`` places the table's files (e.g. on shared storage) instead of the
    session's warehouse folder.
    """
    w = df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


# K2: rows written once to learn how many bytes a row takes in a file.
SIZE_SAMPLE = 100_000


def file_bytes_per_row(df: DataFrame, scratch: str, sample: int = SIZE_SAMPLE, seed: int = 11) -> float:
    """Compressed Parquet bytes a row, from at most ``sample`` random rows written to ``scratch`` (a
    top-k: each task sends that many at most); 0.0 for an empty table."""
    spark = df.sparkSession
    df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(sample).drop("__r").coalesce(1).write.mode("overwrite").parquet(scratch)
    n = spark.read.schema(df.schema).parquet(scratch).count()
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(scratch).agg(F.sum("length")).first()[0]
    return (size or 0) / n if n else 0.0


def byte_sized_write(df: DataFrame, path: str, bytes_per_file: int, scratch: str | None = None,
                     mode: str = "overwrite") -> int:
    """K2 by bytes: files of about ``bytes_per_file``, and how many.  The size of a row is that of a sample
    as it is written, compressed; rows are then dealt evenly over as many files as the table needs."""
    from tenura.session import checkpoint_dir
    scratch = scratch or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/file-size-{uuid.uuid4().hex}"
    files = max(1, round(file_bytes_per_row(df, scratch) * df.count() / bytes_per_file))
    df.repartition(files).write.mode(mode).parquet(path)
    return files


def sized_write(df: DataFrame, path: str, rows_per_file: int, mode: str = "overwrite") -> None:
    """K2: cap file size by rows; a REBALANCE hint lets AQE even out partitions
    first, so small partitions are merged and big ones split."""
    (df.hint("rebalance").write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path))


def _fs(spark: SparkSession, path: str):
    """Hadoop FileSystem for ``path`` (local, HDFS or an object store alike)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """Committed versions of ``name``, oldest first: a version counts once the
    write job has committed it (its ``_SUCCESS`` marker exists)."""
    fs, _ = _fs(spark, root)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}/v-*/_SUCCESS")
    found = fs.globStatus(pattern) or []
    return sorted(str(st.getPath().getParent().toString()) for st in found)


def refresh(spark: SparkSession, df: DataFrame, root: str, name: str, keys: list[str] | None = None,
            keep: int | None = None) -> str:
    """K3: full refresh of a materialised table.

    Each refresh writes a new version directory ``<root>/<name>/v-<time>-<id>``;
    Spark's job commit writes its ``_SUCCESS`` marker last, and readers open the
    newest committed version, so they never see a half-written table (no rename
    or pointer file, so it works the same on HDFS and object stores).  Older
    versions stay unless ``keep`` is given: then committed versions beyond the
    newest ``keep`` are deleted after a successful write, also under a running reader.
    Returns the new version path; ``read_current`` opens the current one.
    """
    stamp = f"{int(time.time() * 1000):015d}"
    version = f"{root.rstrip('/')}/{name}/v-{stamp}-{uuid.uuid4().hex[:8]}"
    if keys:
        cluster_write(df, keys, version)
    else:
        df.write.mode("error").parquet(version)
    for old in _versions(spark, root, name)[:-keep] if keep else []:
        fs, p = _fs(spark, old)
        fs.delete(p, True)
    return version


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """K3: open the newest committed version of a materialised table."""
    versions = _versions(spark, root, name)
    if not versions:
        raise FileNotFoundError(f"no committed version of {name} under {root}")
    return spark.read.parquet(versions[-1])


def export_csv(df: DataFrame, path: str) -> None:
    """Query result as CSV with a header row, written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)
