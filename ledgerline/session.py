"""Spark session helpers.

Cluster settings (``spark.checkpoint.dir``, shuffle partitions, broadcast
threshold) are read from the session; we only fill them in when unset, as in
local tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: scratch folders written by this process, for release()
_SCRATCH: list[str] = []


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "ledgerline", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables and checkpoints.

    Read from ``spark.checkpoint.dir``.  Only when the session has none *and* runs in one process
    (``local[...]``, as in tests) a fresh folder is made; on a cluster a machine-local folder would
    scatter the part files over the executors' disks, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="ledgerline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)          # the configured shared folder, registered for checkpoint()
    return d


#: rows and bytes of a batch of whole texts on its way to Python and back
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches, where the session sets no size: at Spark's 10,000 rows a batch of whole texts holds tens of
    MB, several times over in the JVM's buffers and in each Python worker."""
    for key, value in TEXT_BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name in the shared checkpoint folder (the writer makes the folder)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the scratch folders made so far.  Call it when the results built on them are written:
    a DataFrame returned by the library may still read them lazily before that."""
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, schema=None, **options):
    """Compute ``df`` once and cut its lineage: written as a parquet table under the shared
    checkpoint folder (never a machine-local one) and read back.  For small shared intermediates
    (per-ledger aggregates, a batch read twice) that several branches of one plan read: without it
    each branch re-runs the scan and aggregation, since pruning makes the branches' plans differ and
    exchange reuse misses.  A written table survives executor loss and, unlike a checkpointed RDD,
    gives the optimizer column statistics and pruning when it is read back.  ``options`` go to the writer,
    ``schema`` is that of the table read back, where it is not the written one."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.mode("overwrite").options(**options).parquet(path)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
