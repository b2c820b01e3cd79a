"""Inspection and profile (B1-B5).  Each is one aggregate pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimledger import model as M
from claimledger.session import materialize

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def sample_and_count(df: DataFrame, n: int = M.SAMPLE_ROWS) -> DataFrame:
    """B1: a bounded sample for types/nulls plus the true row count.

    One row: (total_rows, sample_rows, sampled).  The sample is ``limit(n)``
    (no global sort); the count is a separate cheap pass.
    """
    sample = df.limit(n).agg(F.count(F.lit(1)).alias("sample_rows"))
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return (total.withColumn("_k", F.lit(1)).join(sample.withColumn("_k", F.lit(1)), "_k")
            .select("total_rows", "sample_rows", (F.col("total_rows") > F.lit(n)).alias("sampled")))


def describe(df: DataFrame, table: str = "") -> DataFrame:
    """B2: (table, column, dtype, rows, nulls) from ONE aggregate, unpivoted."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        isnull = c.isNull() | (F.isnan(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.lit(False))
        aggs.append(F.count_if(isnull).alias(f"_n{i}"))
    row = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                                 F.col(f"_n{i}").alias("nulls"))
                        for i, f in enumerate(df.schema.fields)])
    return row.select(F.lit(table).alias("table"), F.col("_rows").alias("rows"), F.inline(entries))


def head(df: DataFrame, n: int = 3, order_by: list[str] | None = None) -> DataFrame:
    """B2: first rows; ordered by the given columns when stated (top-k, no
    global sort)."""
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def column_profile(df: DataFrame, table: str = "", columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: min, max, count, nulls, distinct, zeros and
    the share of rows at the maximum (a ceiling / sentinel hint).

    One scan: every column's values are counted (map-side first), and all
    figures are read off these counts.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, NUMERIC)
              and (columns is None or f.name in columns)]
    entry = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{f.name}`").cast("double").alias("v"))
                      for i, f in enumerate(fields)])
    counts = df.select(F.inline(entry)).groupBy("_i", "v").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("v").isNotNull()
    stats = counts.groupBy("_i").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("count"),
        F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("nulls"), F.count("v").alias("distinct"),
        F.sum(F.when(F.col("v") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum("n").alias("_rows"),
        F.max(F.when(there, F.struct("v", "n"))).alias("_top"))
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
                                            "_i int, column string, dtype string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return names.join(stats, "_i", "left").select(
        F.lit(table).alias("table"), "column", "dtype", "min", "max", zero("count"), zero("nulls"), zero("distinct"),
        zero("zeros"), F.try_divide(F.col("_top.n").cast("double"), F.col("_rows").cast("double")).alias("share_at_max"))


def domain_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Value frequencies of a low-cardinality column, most frequent first
    (ties by value); top-k when ``k`` is given."""
    g = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if k is not None:
        g = g.orderBy(F.desc("n"), F.asc("value")).limit(k)
    return g


def all_zero_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """(rows, all_zero) - records whose listed measures are all zero."""
    pred = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == 0, F.lit(False)) for c in cols])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(pred).alias("all_zero"))


#: Numbers that commonly stand for "missing".
USUAL_SENTINELS = (0.0, -1.0, 9.0, 99.0, 999.0, 9999.0, -9.0, -99.0, -999.0, -9999.0, 1e9)


def sentinel_profile(df: DataFrame, columns: list[str] | None = None, share: float = 0.01, weight: float = 5.0,
                     gap: float = 3.0) -> DataFrame:
    """(column, dtype, value, n, share, position) for every suspected sentinel.

    A value is suspected when it is a heavy hitter, at least ``share`` of the
    column's rows, and stands apart: at an edge, ``gap`` times the mean
    distance of the other values away from its neighbour, and no rarer than
    they are; or it is one of the usual sentinels (or the empty text), not
    simply one of a few codes (so is a text), and ``weight`` times as frequent as the others.
    Numbers are judged by value, dates by day, texts by length.  Columns of
    other types are left out.

    One scan counts the values (map-side first); the edges and their
    neighbours are aggregates over these counts, so no column's values are
    sorted or gathered, whatever its cardinality.
    """
    kinds = {}
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        if isinstance(f.dataType, NUMERIC):
            kinds[f.name] = "number"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[f.name] = "date"
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = "text"
    names = list(kinds)
    size = {"number": lambda c: c.cast("double"), "date": lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01")).cast("double"),
            "text": lambda c: F.length(c).cast("double")}
    entry = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{n}`").cast("string").alias("value"),
                               size[kinds[n]](F.col(f"`{n}`")).alias("v")) for i, n in enumerate(names)])
    if not names:
        return df.sparkSession.createDataFrame([], "column string, dtype string, value string, n long, share double, position string")
    counts = materialize(df.select(F.inline(entry)).where(F.col("v").isNotNull() & ~F.isnan("v"))
                         .groupBy("_i", "v", "value").agg(F.count(F.lit(1)).alias("n")))
    # columns are few, so their statistics are a bounded table
    edge = counts.groupBy("_i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("rows"),
                                    F.count(F.lit(1)).alias("distinct"))
    inner = counts.join(F.broadcast(edge), "_i")
    near = inner.groupBy("_i").agg(F.min(F.when(F.col("v") > F.col("lo"), F.col("v"))).alias("lo2"),
                                   F.max(F.when(F.col("v") < F.col("hi"), F.col("v"))).alias("hi2"))
    c = inner.join(F.broadcast(near), "_i")
    others = F.col("distinct") - 1
    heavy = lambda times: ((F.col("n") >= share * F.col("rows")) & (others > 0)
                           & (F.col("n") * others >= times * (F.col("rows") - F.col("n"))))
    low, high = F.col("v") == F.col("lo"), F.col("v") == F.col("hi")
    # the other values' extent, over their number of steps
    step = F.when(low, F.col("hi") - F.col("lo2")).otherwise(F.col("hi2") - F.col("lo")) / F.greatest(others - 1, F.lit(1))
    away = F.when(low, F.col("lo2") - F.col("v")).otherwise(F.col("v") - F.col("hi2"))
    kind = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(kinds[n]))]), F.col("_i"))
    apart = ((low | high) & (away > gap * F.greatest(step, F.lit(0.0)))
             & (F.col("distinct") > F.when(kind == "text", 10).otherwise(2)))
    usual = F.when(kind == "number", F.col("v").isin(list(USUAL_SENTINELS))).when(kind == "text", F.col("v") == 0).otherwise(
        F.lit(False)) & (F.col("distinct") > 10)
    pick = lambda of: F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(of(n)))]), F.col("_i"))
    return c.where((heavy(1.0) & apart) | (heavy(weight) & usual)).select(
        pick(lambda n: n).alias("column"), pick(lambda n: df.schema[n].dataType.simpleString()).alias("dtype"), "value", "n",
        (F.col("n") / F.col("rows")).alias("share"),
        F.when(apart & low, "below").when(apart & high, "above").otherwise("usual").alias("position"))
