"""File manifests and load audit.

An inventory is a table of listing snapshots (path, md5, snapshot time); the
control table records which files were registered.  All steps are joins and
windows keyed by file, so the driver never iterates over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.text import file_entity, file_name
from tenura.operators.filters import blank_safe_eq
from tenura.operators.windows import latest_row


def latest_files(inv: DataFrame, path: str = "relative_path", md5: str = "md5", ts: str = "snapshot_at",
                 tie: str | None = None) -> DataFrame:
    """Latest snapshot per (path, md5)."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    return latest_row(inv, [path, md5], order)


def new_files(control: DataFrame, listing: DataFrame, path: str = "relative_path", md5: str = "md5",
              size: str = "size", modified: str = "last_modified") -> DataFrame:
    """Listing rows not yet in the control table, keyed on (file name, md5) with
    NULL md5 equal to ''; the entity is the third '-' token of the file name."""
    s = listing.select(file_name(path).alias("file_name"), F.col(size).alias("file_size"),
                       F.col(md5).alias("file_md5"), F.col(modified).alias("file_last_modified"))
    c = control.select(F.col("file_name").alias("__fn"), F.col("file_md5").alias("__md5"))
    new = s.join(c, (s["file_name"] == c["__fn"]) & blank_safe_eq(s["file_md5"], c["__md5"]), "left_anti")
    return new.select(file_entity("file_name", 3, "-").alias("source_entity"), "file_name", "file_size",
                      "file_md5", "file_last_modified")


def register_files(control: DataFrame, listing: DataFrame, **cols) -> DataFrame:
    """Idempotent manifest insert; returns the new control table
    (old rows + listing rows not registered yet)."""
    return control.unionByName(new_files(control, listing, **cols), allowMissingColumns=True)


def pending(files: DataFrame, loaded: DataFrame, keys=("file_name",)) -> DataFrame:
    """Files not yet recorded as loaded (left anti join on the manifest)."""
    return files.join(loaded.select(*keys).distinct(), list(keys), "left_anti")


def load_summary(landed: DataFrame, expected: DataFrame, run: str = "run_id", table: str = "source_table",
                 ts: str = "ingested_at") -> DataFrame:
    """Per (run, table) rows landed, first/last ingest time and status;
    expected tables without rows show as FAILED."""
    got = landed.groupBy(run, table).agg(F.count(F.lit(1)).alias("rows_landed"), F.min(ts).alias("started_at"),
                                         F.max(ts).alias("finished_at"))
    j = expected.select(run, table).join(got, [run, table], "left")
    return j.select(run, table, F.coalesce("rows_landed", F.lit(0).cast("bigint")).alias("rows_landed"),
                    "started_at", "finished_at",
                    F.when(F.col("rows_landed") > 0, "SUCCESS").otherwise("FAILED").alias("status"))
