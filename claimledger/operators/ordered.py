"""Exact order statistics without gathering a group into one task.

``percentile`` keeps every distinct value of a group in one hash map and
merges them in one task; a hot group (a third of all rows) or a whole-table
median over a high-cardinality column would then sit in one executor.  Here
the work is spread instead:

1. count rows per (keys, value)             -- partial aggregation, hash shuffle
2. range-partition those counts on (keys, value) and tag each row with its
   partition id; write them to the checkpoint folder so both consumers
   read the same assignment
3. cumulative counts inside (partition, keys) -- window, balanced by partition
4. per-partition subtotals -> offsets by a window over at most P rows per key
5. join offsets back: every (keys, value) knows how many rows precede it.

Ranks and quantiles are then row-local arithmetic plus a tiny aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimledger.session import materialize


def _num_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def cumulative_counts(df: DataFrame, keys: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """(keys..., value, cnt, before, n) for every distinct non-null value.

    ``before`` = rows of the same key group with a strictly smaller value,
    ``n`` = non-null rows of the group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    return cumulate(counts, keys, value, partitions)


def cumulate(counts: DataFrame, keys: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """``cumulative_counts`` from a table (keys..., value, cnt).  The range-
    partitioned counts are written once; both consumers read them."""
    p = _num_partitions(counts, partitions)
    ranged = materialize(counts.repartitionByRange(p, *[F.col(k) for k in keys], F.col(value))
                         .withColumn("_pid", F.spark_partition_id()))
    grp = ["_pid", *keys]
    w_local = Window.partitionBy(*grp).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_lb", F.coalesce(F.sum("cnt").over(w_local), F.lit(0)))
    sub = ranged.groupBy(*grp).agg(F.sum("cnt").alias("_ps"))
    key_part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offs = (sub.withColumn("_off", F.coalesce(F.sum("_ps").over(
                    key_part.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("n", F.sum("_ps").over(key_part))
               .drop("_ps"))
    return (join_null_safe(local, offs, grp)
            .select(*keys, value, "cnt", (F.col("_off") + F.col("_lb")).alias("before"), "n"))


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL keys match NULL keys (group keys may
    be NULL); keeps one copy of the key columns."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def exact_quantiles(df: DataFrame, keys: list[str], value, probs: list[float],
                    partitions: int | None = None) -> DataFrame:
    """(keys..., p, q): linear interpolation between order statistics
    (same as pandas ``quantile``, Spark ``percentile``, DuckDB ``quantile_cont``).
    NULLs are skipped; an all-NULL group yields no row."""
    vcol = "_v"
    base = df.select(*keys, F.col(value).cast("double").alias(vcol) if isinstance(value, str)
                     else value.cast("double").alias(vcol))
    cum = cumulative_counts(base, keys, vcol, partitions)
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        covers = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("cnt"))
        aggs.append(F.max(F.when(covers(lo), F.col(vcol))).alias(f"lo{i}"))
        aggs.append(F.max(F.when(covers(hi), F.col(vcol))).alias(f"hi{i}"))
        aggs.append(F.first(h - lo).alias(f"fr{i}"))
    g = cum.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"),
                              (F.col(f"lo{i}") + F.col(f"fr{i}") * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias("q"))
                     for i, p in enumerate(probs)])
    return g.select(*keys, F.inline(rows))
