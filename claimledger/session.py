"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "claimledger") -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the caller's session (and its spark.checkpoint.dir) wins:
    ``getOrCreate`` returns it unchanged.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        # local mode: the driver JVM is the only executor
        b = b.config("spark.driver.memory", os.environ.get("CLAIMLEDGER_DRIVER_MEMORY", "12g"))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, benches) with the setting unset gets a
    scratch folder of our own; on a cluster an unset setting is an error,
    never a machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for written tables")
        d = tempfile.mkdtemp(prefix="claimledger-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    return d


def spread(df, *keys: str):
    """Rows dealt by ``keys`` over all tasks, for costly work on rows that a
    few row groups hold; an explicit number isn't coalesced again."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def lean(spark: SparkSession, size: str = "4m") -> None:
    """Whole texts travel between Spark and Python in batches of a few MB:
    the default batch of 64 MB is held several times over by every task,
    outside the heap.  A session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


def materialize(df, options=None):
    """Cut lineage by writing a table into the shared checkpoint folder and
    reading it back.

    Used where a frame is read by several plans (claim tables, the range-
    partitioned count tables of the ordered operators): each plan then
    starts from stored rows, a lost executor does not force recomputation
    of the upstream plan, and the file statistics let AQE size joins.
    Unlike ``checkpoint()`` the input is computed once.  Partitioning is
    kept as written: files are read back one task per written partition
    when ``keep_partitions`` is needed by the caller.  ``options`` are the
    writer's.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/mat-{uuid.uuid4().hex}"
    df.write.options(**options or {}).mode("error").parquet(path)
    return spark.read.parquet(path)
