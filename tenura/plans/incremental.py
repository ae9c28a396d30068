"""K3: refreshing only what changed.  P8 / P9: rewriting only the files that hold touched rows.

``materialise`` lays a table out in buckets of its key.  ``refresh_changed`` takes the keys
whose rows may differ, rebuilds those rows only, and overwrites the partitions that hold
them.  ``changed_titles`` finds the keys by comparing the silver tables before and after.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.operators.filters import CURRENT_CODES, current_flag
from tenura.session import checkpoint_dir, release

BUCKET = "bucket"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def _write(df: DataFrame, path: str, key: str, derive: Callable[[DataFrame], DataFrame] | None) -> None:
    """One file per bucket; only the buckets of ``df`` are replaced."""
    out = df.repartition(BUCKET)
    out = out if derive is None else derive(out)
    (out.sortWithinPartitions(BUCKET, key).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))


def materialise(df: DataFrame, path: str, key: str, buckets: int,
                derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """K3, first load: ``df`` in ``buckets`` partitions by a hash of ``key`` (about a file's worth each).

    ``derive`` adds columns that follow from the row alone; it runs where the rows are written, so
    the columns are not shuffled."""
    _write(df.select("*", _bucket(key, buckets)), path, key, derive)
    release(df.sparkSession)


def read_materialised(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def refresh_changed(spark: SparkSession, path: str, key: str, buckets: int, changed: DataFrame,
                    build: Callable[[DataFrame], DataFrame],
                    derive: Callable[[DataFrame], DataFrame] | None = None) -> list[int]:
    """K3: make the table at ``path`` equal to a full rebuild, given the keys that may differ.

    ``build(keys)`` returns the table's rows of these keys (none for a deleted one), without the
    columns of ``derive``.  The rows of other keys in the same buckets are kept; other buckets are not
    read.  Stored rows, changed keys and new rows meet in the one shuffle by bucket that the write needs.
    New partitions are written beside the table first, under a name that readers skip, so a failed
    rebuild changes nothing, and moved in.  Returns the buckets rewritten.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/refresh-{uuid.uuid4().hex}"
    changed.select(F.col(key), _bucket(key, buckets)).distinct().write.parquet(f"{folder}/keys")
    release(spark)
    keys = spark.read.parquet(f"{folder}/keys")
    touched = sorted(r[0] for r in keys.select(BUCKET).distinct().collect())     # at most ``buckets``
    if not touched:
        return []
    fresh = build(keys.select(key)).select("*", _bucket(key, buckets))
    now = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).select(*fresh.columns)
    rows = (now.select("*", F.lit("stored").alias("__row")).unionByName(fresh.select("*", F.lit("new").alias("__row")))
            .unionByName(keys.select("*", F.lit("key").alias("__row")), allowMissingColumns=True))

    def current(df: DataFrame) -> DataFrame:
        # one group per key, null among them
        rebuilt = F.bool_or(F.col("__row") == "key").over(Window.partitionBy(BUCKET, key))
        out = (df.withColumn("__rebuilt", rebuilt)
               .where((F.col("__row") == "new") | ((F.col("__row") == "stored") & ~F.col("__rebuilt"))).drop("__row", "__rebuilt"))
        return out if derive is None else derive(out)
    staged = f"{path.rstrip('/')}/_rewrite-{uuid.uuid4().hex}"
    _write(rows, staged, key, current)
    fs, _ = _fs(spark, staged)
    for b in touched:
        name = f"{BUCKET}={b}"
        new, old = _fs(spark, f"{staged}/{name}")[1], _fs(spark, f"{path.rstrip('/')}/{name}")[1]
        fs.delete(old, True)                        # of a bucket without rows no files are left
        if fs.exists(new) and not fs.rename(new, old):
            raise OSError(f"{new} could not be moved to {old}")
    _delete(spark, staged)
    _delete(spark, folder)
    release(spark)
    return touched


# The tables that hold a title number, and the others by the column that leads to one.
TITLE_KEYS = {"title": "title_no", "title_estate": "ttl_title_no", "title_instrument_title": "ttl_title_no",
              "title_encumbrance": "ttl_title_no", "title_parcel_association": "ttl_title_no",
              "title_hierarchy": "ttl_title_no_flw"}
VIA = {"title_instrument": ("id", "title_instrument_title", "tin_id"),
       "estate_share": ("ett_id", "title_estate", "id"),
       "appellation": ("par_id", "title_parcel_association", "par_id"),
       "address_point": ("parcel_id", "title_parcel_association", "par_id"),
       "land_district": ("ldt_loc_id", "title", "ldt_loc_id")}

# The columns that the search table (G18) is made of; a change of any other leaves its rows alone.
SEARCH_COLUMNS = {
    "title": ("title_no", "ldt_loc_id", "status", "type", "register_type", "issue_date", "guarantee_status", "maori_land",
              "is_current"),
    "land_district": ("ldt_loc_id", "name"),
    "title_estate": ("id", "ttl_title_no", "type", "is_current"),
    "estate_share": ("id", "ett_id"),
    "proprietor": ("id", "ets_id", "status", "type", "prime_surname", "prime_other_names"),
    "title_instrument_title": ("ttl_title_no", "tin_id"),
    "title_instrument": ("id", "inst_no", "trt_grp", "trt_type", "status", "lodged_date"),
    "title_encumbrance": ("ttl_title_no", "is_current"),
    "title_parcel_association": ("ttl_title_no", "par_id"),
    "title_hierarchy": ("id", "status", "ttl_title_no_prior", "ttl_title_no_flw"),
    "address_point": ("address_id", "parcel_id", "status"),
    "address_component": ("address_id", "component_type", "component_value", "end_lifecycle"),
    "appellation": ("par_id", "title_flag", "status", "appellation_value"),
}


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(k): values of ``key`` whose rows are not the same bag before and after."""
    cols = after.columns
    both = before.select(*cols, F.lit(-1).alias("__n")).unionByName(after.select(*cols, F.lit(1).alias("__n")))
    return (both.groupBy(*cols).agg(F.sum("__n").alias("__n")).where("__n <> 0")
            .select(F.col(key).alias("k")).distinct())


def changed_titles(before, after) -> DataFrame:
    """(title_no): titles whose row in the search table may differ between two states of the
    silver tables.  Only the columns the table is made of are compared, and shuffled.  A changed
    code list or transaction type asks for a full refresh."""
    def changed(table: str, key: str) -> DataFrame:
        old, new = getattr(before, table), getattr(after, table)
        cols = [c for c in SEARCH_COLUMNS[table] if c in new.columns]
        return changed_keys(old.select(*cols), new.select(*cols), key)
    found = [changed(n, k) for n, k in TITLE_KEYS.items()]

    def titles_of(keys: DataFrame, table: str, column: str) -> list[DataFrame]:
        # of both states: a link that went away still names a title to rebuild
        return [getattr(t, table).join(keys, F.col(column) == F.col("k"), "left_semi")
                .select(F.col(TITLE_KEYS[table]).alias("k")) for t in (before, after)]
    for name, (column, table, other) in VIA.items():
        found += titles_of(changed(name, column), table, other)
    # owners hang on a share, components on an address point
    owners = changed("proprietor", "ets_id")
    points = changed("address_component", "address_id")
    for t in (before, after):
        shares = t.estate_share.join(owners, F.col("id") == F.col("k"), "left_semi").select(F.col("ett_id").alias("k"))
        parcels = t.address_point.join(points, F.col("address_id") == F.col("k"), "left_semi").select(
            F.col("parcel_id").alias("k"))
        found += titles_of(shares, "title_estate", "id") + titles_of(parcels, "title_parcel_association", "par_id")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("k is not null").distinct().withColumnRenamed("k", "title_no")


class OfTitles:
    """The silver tables cut down to some titles: every table that holds a title number is
    semi-joined, so the joins that lead away from it shrink with it."""

    def __init__(self, tables, titles: DataFrame):
        self._tables, self._titles = tables, titles

    def __getattr__(self, name: str) -> DataFrame:
        df = getattr(self._tables, name)
        if name not in TITLE_KEYS:
            return df
        return df.join(self._titles.select(F.col("title_no").alias("__k")), F.col(TITLE_KEYS[name]) == F.col("__k"), "left_semi")


# ---------------------------------------------------------------------------
# P8 / P9 on files
# ---------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _files(rows: DataFrame) -> list[str]:
    """Files that hold the rows; a list of names, as the scan itself keeps one."""
    return sorted(r[0] for r in rows.select("_metadata.file_path").distinct().collect())


def replace_files(spark: SparkSession, path: str, files: Iterable[str], rows: DataFrame) -> None:
    """Copy on write: ``rows`` take the place of ``files`` in the table at ``path``.

    They are written beside the table, under a name that readers skip, and moved in after the
    write job has committed; then the old files go.  All other files stay as they are."""
    staged = f"{path.rstrip('/')}/_rewrite-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, path)
    for status in fs.listStatus(source):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(target, name))
    fs.delete(source, True)
    for f in files:
        _delete(spark, f)


def reflag_files(spark: SparkSession, path: str, codes: Iterable[str] = CURRENT_CODES, status: str = "status",
                 flag: str = "is_current") -> list[str]:
    """P8 on a stored table: recompute the flag in the files where it changes.  Returns these files."""
    table = spark.read.parquet(path)
    new = current_flag(status, tuple(codes))
    files = _files(table.where(~F.col(flag).eqNullSafe(new)))
    if files:
        old = spark.read.schema(table.schema).parquet(*files)
        replace_files(spark, path, files, old.withColumn(flag, new).select(*table.columns))
    return files


def upsert_code_files(spark: SparkSession, path: str, seed: DataFrame, keys: tuple[str, ...] = ("code_group", "code"),
                      desc: str = "description") -> list[str]:
    """P9 on a stored table: fill missing descriptions from ``seed`` in the files that hold one, and
    add the codes it lacks in files of their own.  Returns the files rewritten."""
    table = spark.read.parquet(path)
    given = seed.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(desc).alias("__new"))

    def same(df: DataFrame):
        cond = F.lit(True)
        for k in keys:
            cond = cond & (df[k] == given[f"__{k}"])
        return cond
    empty = table.where(F.col(desc).isNull())                  # min/max and null counts prune the scan
    files = _files(empty.join(given.where("__new is not null"), same(empty), "left_semi"))
    known = table.select(*keys)
    missing = seed.select(*keys, desc).join(known, list(keys), "left_anti")
    # both results are settled before any file changes
    folder = f"{checkpoint_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    missing.write.parquet(folder)
    if files:
        old = spark.read.schema(table.schema).parquet(*files)
        filled = old.join(given, same(old), "left").withColumn(desc, F.coalesce(desc, "__new")).select(*table.columns)
        replace_files(spark, path, files, filled)
    add = spark.read.schema(missing.schema).parquet(folder)
    if not add.isEmpty():
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in (*keys, desc)]
        replace_files(spark, path, [], add.select(*keys, desc, *others).select(*table.columns))
    return files
