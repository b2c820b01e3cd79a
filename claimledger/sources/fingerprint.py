"""Table identity (A8, A9) and source sizes.

*Byte* fingerprint: sha256 of each file's bytes (order-sensitive inside a
file), folded over files by an order-free aggregate of (name, hash); a
single-file source yields exactly the file's sha256.

*Content* fingerprint: a hash per row over a canonical text of its values,
folded with count + xor + sum.  It is invariant to file layout, partitioning
and row order, computed in one aggregate (optionally per key, e.g. per day),
and engine-neutral: the canonical text uses fixed formats for every type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimledger import model as M
from claimledger.sources import raw_files


def exact_double(c: Column) -> Column:
    """Engine-neutral text of a double that keeps every bit: mantissa (53-bit
    integer), ``p`` and binary exponent.  Scaling by powers of two is exact;
    very large and very small numbers are first moved towards one."""
    a = F.abs(c.cast("double"))
    move = F.when(a >= 2.0 ** 1000, F.lit(-600)).when(a < 2.0 ** -1000, F.lit(600)).otherwise(F.lit(0))
    two = lambda e: F.pow(F.lit(2.0), e)
    b = a * two(move)
    guess = F.floor(F.log2(b))
    m = b / two(guess)  # the logarithm may be off by one
    fix = F.when(m >= 2, 1).when(m < 1, -1).otherwise(0)
    digits = (m * two(F.lit(52) - fix)).cast("bigint").cast("string")
    text = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), digits, F.lit("p"),
                    (guess + fix - move - 52).cast("string"))
    return (F.when(c.isNull(), F.lit(None).cast("string")).when(F.isnan(c), F.lit("NaN"))
             .when(a == float("inf"), F.when(c < 0, F.lit("-Infinity")).otherwise(F.lit("Infinity")))
             .when(a == 0, F.lit("0")).otherwise(text))


def canonical(c: Column, dtype: T.DataType) -> Column:
    """Engine-neutral text of one value: doubles exactly, decimals at their
    own scale, timestamps to microseconds."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return exact_double(c)
    if isinstance(dtype, T.TimestampType) or isinstance(dtype, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def row_text(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Length-prefixed fields joined by '|', NULL as '-': separators inside
    values cannot collide with field boundaries."""
    cols = cols or df.columns
    parts = []
    for name in cols:
        s = canonical(F.col(f"`{name}`"), df.schema[name].dataType)
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.concat_ws("|", *parts)


def _chunk(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("bigint")


def content_fingerprint(df: DataFrame, cols: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys..., n_rows, fingerprint): one aggregate, no sort, no collect."""
    keys = keys or []
    cols = cols or [c for c in df.columns if c not in keys]
    h = df.select(*keys, F.sha2(row_text(df, cols), 256).alias("_h"))
    agg = h.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(_chunk(F.col("_h"), 0)).alias("_x1"), F.bit_xor(_chunk(F.col("_h"), 1)).alias("_x2"),
        F.sum(_chunk(F.col("_h"), 2).cast("decimal(38,0)")).alias("_s3"),
        F.sum(_chunk(F.col("_h"), 3).cast("decimal(38,0)")).alias("_s4"))
    fp = F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("_x1").cast("string"),
                            F.col("_x2").cast("string"), F.col("_s3").cast("string"),
                            F.col("_s4").cast("string")), 256)
    return agg.select(*keys, "n_rows", fp.alias("fingerprint"))


def byte_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(source, n_files, bytes, sha256) for the files under ``path``, of any
    length: each is hashed in one pass of constant memory (for one file hashed
    by many tasks see ``raw_files.tree_roots``).  Only where tasks can't open
    the scheme themselves a file is one value of a row, up to 2 GB.  Files
    without any byte are not read and don't count."""
    listed = raw_files.listing(spark, path)
    one = listed.select("path").first()
    if one is None or raw_files.scheme_of(one["path"]) in raw_files.SCHEMES:
        files = raw_files.whole_hashes(listed).withColumnRenamed("sha256", "h")
    else:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                 .select("path", "length", F.sha2(F.col("content"), 256).alias("h")))
    root = path.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^.*?" + root.replace(".", r"\.").lstrip("/") + "/?", "")
    named = files.select(rel.alias("name"), "length", "h",
                         F.sha2(F.concat_ws(":", rel, F.col("h")), 256).alias("nh"))
    agg = named.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"),
                    F.first("h").alias("_one"),
                    F.bit_xor(_chunk(F.col("nh"), 0)).alias("_x1"), F.bit_xor(_chunk(F.col("nh"), 1)).alias("_x2"),
                    F.sum(_chunk(F.col("nh"), 2).cast("decimal(38,0)")).alias("_s3"))
    folded = F.sha2(F.concat_ws(":", F.col("n_files").cast("string"), F.col("_x1").cast("string"),
                                F.col("_x2").cast("string"), F.col("_s3").cast("string")), 256)
    return agg.select(F.lit(path).alias("source"), "n_files", "bytes",
                      F.when(F.col("n_files") == 1, F.col("_one")).otherwise(folded).alias("sha256"))


def source_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(source, bytes) from a file listing only: ``content`` is never read."""
    from functools import reduce
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
             .agg(F.sum("length").alias("bytes")).select(F.lit(name).alias("source"), "bytes")
             for name, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def large_source_warnings(claims: DataFrame, sizes: DataFrame, threshold_mb: float = M.LARGE_SOURCE_MB) -> DataFrame:
    """One WARN per (project, source) at or above the threshold; absent
    sources (no size) are skipped."""
    s = claims.select("project", F.explode_outer("sources").alias("s")).select("project", F.col("s.path").alias("source"))
    j = s.where(F.col("source").isNotNull()).distinct().join(sizes, "source")
    mb = F.col("bytes") / (1024.0 * 1024.0)
    return j.where(mb >= threshold_mb).select(
        "project", F.lit("source_size:large").alias("check"), F.lit(M.WARN).alias("severity"),
        F.lit(None).cast("string").alias("finding_id"),
        F.format_string("%s is %.0f MB (threshold %s MB)", F.col("source"), mb, F.lit(str(threshold_mb))).alias("detail"))
