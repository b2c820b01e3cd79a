"""Registration gate as a Structured Streaming query.

New findings arrive as JSON-lines files (one finding per line, field
``project`` optional).  Every micro-batch is registered against the ledger
accumulated so far with the batch operator (:func:`register`): defects and
ids already taken are rejected with reasons, the rest is appended.  The
micro-batch is written under its batch id, so a replayed batch after a
failure overwrites its own output instead of duplicating it (idempotent
sink); the stream's progress lives in the checkpoint location, which must be
a shared folder on a cluster.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimledger.operators.registration import register


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything else must not look like an empty ledger
            raise
        return spark.createDataFrame([], schema)


def start_gate(spark: SparkSession, inbox: str, accepted_path: str, rejected_path: str, checkpoint: str,
               now: str, project: str = "default", trigger_once: bool = True, files_per_batch: int | None = None):
    """Start the gate; returns the StreamingQuery."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = (reader.load(inbox)
              .select(F.coalesce(F.get_json_object("value", "$.project"), F.lit(project)).alias("project"),
                      F.col("value").alias("doc")))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        existing = _read_or_empty(sp, accepted_path, "project string, id string, rev int, doc string, batch long")
        existing = existing.where(F.col("batch") < batch_id)  # a replayed batch doesn't meet its own rows
        acc, rej = register(existing.select("project", "doc"), batch, "stream", now)
        # partition by batch id + dynamic overwrite: a replayed batch replaces its own rows
        (acc.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(accepted_path))
        (rej.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejected_path))

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()
