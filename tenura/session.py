"""Session helpers.

The library never creates a cluster session behind the user's back: operators take
DataFrames.  ``get_spark`` is for tests, the bench and the command line; it sets
only what is unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings we want for every run; each is applied only when the session
# does not already carry a value (cluster configuration wins).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tenura") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local") and "driver-memory" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
            # local mode runs every task in the driver JVM; Spark's 1g default is too
            # small for the many concurrent sorters of the wide gold tables
            builder = builder.config("spark.driver.memory", "8g")
    builder = builder.config("spark.ui.enabled", "false")
    # delete checkpoint files once their DataFrames are garbage collected (core
    # setting: only takes effect when this call creates the context)
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared, fault-tolerant path set by the operator
    of the cluster; we only read it.  When it is unset on a local master
    (tests, a laptop), a fresh scratch folder is created and registered; when it
    is unset on a cluster, this raises instead.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
    if not cur:
        if not spark.sparkContext.master.startswith("local"):
            # A machine-local folder would not survive the loss of an executor.
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for this cluster")
        cur = tempfile.mkdtemp(prefix="tenura-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", cur)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cur)
    return cur


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of steps that are done.

    It does so only once their plans are collected on the driver, which a driver with memory to spare
    may not come to before the last step (``spark.cleaner.periodicGC.interval`` is half an hour).
    """
    gc.collect()
    spark._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session (once per context).

    Needed where the package is only on the driver's ``sys.path``; a job submitted with
    ``--py-files`` does not depend on it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tenura_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tenura-py-"), "tenura_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tenura_shipped = True
