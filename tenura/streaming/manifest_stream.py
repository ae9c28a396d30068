"""Incremental file manifest with Structured Streaming (S11 continuous form).

Listing snapshots arrive as JSON-lines files in a landing folder (one object
per listed file: relative_path, size, md5, last_modified).  A file-source stream
picks up only new snapshot files (the source's own log is the exactly-once
state, kept in the checkpoint folder); each micro-batch keeps the latest
snapshot per (path, md5) and appends to the control table only the files not
registered yet (left anti join on file name + md5, NULL md5 equal to '').
``trigger(availableNow=True)`` processes everything pending and stops, so the
same code serves a nightly batch and a long-running stream.

A micro-batch that is replayed after a failure (the append landed, the offset
commit did not) appends nothing new: its files are already in the control
table, and the anti-join removes them.  The sink is idempotent, so the stream
registers each file exactly once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tenura.sources.manifest import latest_files, new_files

LISTING_SCHEMA = "relative_path string, size bigint, md5 string, last_modified timestamp, snapshot_at timestamp"
CONTROL_SCHEMA = ("source_entity string, file_name string, file_size bigint, file_md5 string, "
                  "file_last_modified timestamp")


def _control(spark: SparkSession, control_path: str) -> DataFrame:
    try:
        return spark.read.schema(CONTROL_SCHEMA).parquet(control_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":     # anything else is no first run
            raise
        return spark.createDataFrame([], CONTROL_SCHEMA)


def run_manifest_stream(spark: SparkSession, landing_dir: str, control_path: str, checkpoint: str,
                        available_now: bool = True):
    """Start (and with ``available_now`` wait for) the manifest stream; returns the query."""
    listing = spark.readStream.schema(LISTING_SCHEMA).json(landing_dir)

    def register_batch(batch: DataFrame, batch_id: int) -> None:
        latest = latest_files(batch, tie=None)
        new_files(_control(spark, control_path), latest).write.mode("append").parquet(control_path)

    w = listing.writeStream.foreachBatch(register_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
