"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimledger.session import checkpoint_dir, lean, materialize  # noqa: F401  (re-exported)

#: Fixed value: the word pattern of the contracts (runs of anything but ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def stored_at(df: DataFrame) -> list[str]:
    """Folders that ``df`` is read from."""
    return sorted({f.rpartition("/")[0] for f in df.inputFiles()})


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables (results of ``materialize`` itself) that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in stored_at(df):
            if folder.rpartition("/")[2].startswith("mat-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def parts(spark: SparkSession) -> int:
    """The session's own shuffle width: explicit repartitions follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_RESIDENT: dict = {}


def resident(key, build):
    """What a Python worker keeps between tasks: one object at most, the one
    last asked for.  Workers are reused by later stages, so models and caches
    of a stage before must not stay next to those of this one."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Drop what the worker keeps; for tasks that keep nothing of their own."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Cut a batch into slices of about ``max_bytes`` of text, at least one
    row each, so that the memory of vectorised work does not follow the
    batch size."""
    i = batch.schema.get_field_index(column)
    lens = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for row, n in enumerate(lens):
        if size and size + n > max_bytes:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def held_out(doc_id, modulus: int, remainder: int):
    """The contracts' split: crc32 of the id's decimal text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


#: A key with more than one in HEAVY of all rows is heavy: there are fewer than HEAVY such keys.
HEAVY = 10_000


def join_by_key(rows: DataFrame, answers: DataFrame, key: str, values: list[str], n: str, total: int,
                spread: list[str]) -> DataFrame:
    """Left join of ``answers`` (unique string ``key``, its row count ``n``)
    onto ``rows``, whatever one key holds: heavy keys, fewer than HEAVY by
    definition, come by broadcast, all others by a shuffle in which heavy
    rows are dealt out by a hash of the columns ``spread``."""
    tag = lambda df, p: df.select(F.col(key).alias(f"__{p}k"), *[F.col(v).alias(f"__{p}{v}") for v in values])
    big = F.col(n) * F.lit(HEAVY) > F.lit(total)
    out = rows.join(F.broadcast(tag(answers.where(big), "h")), F.col(key) == F.col("__hk"), "left")
    out = out.withColumn("__k", F.when(F.col("__hk").isNotNull(), F.concat(
        F.lit("\0"), F.xxhash64(*spread).cast("string"))).otherwise(F.col(key)))
    out = out.join(tag(answers.where(~big), "l"), F.col("__k") == F.col("__lk"), "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(f"__h{v}", f"__l{v}"))
    return out.drop("__k", "__hk", "__lk", *[f"__{p}{v}" for p in "hl" for v in values])
