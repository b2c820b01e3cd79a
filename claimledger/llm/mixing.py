"""Operator 6 [native]: mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the
source's target over its size.  Documents stand in a fixed order within
their source (size class, hash bucket, size, id); the expected copies are
prefix-summed in that order, one random offset per source is added, and a
document is emitted once for each integer that its interval crosses.  As
the order goes by size, every stretch of the sum holds all sizes and the
words taken come near the target.

Plan: the prefix sum has two levels.  Rows are numbered within (source,
size class, hash bucket), of which each source has a bounded number, and
the counts of these groups, a small table, are summed over the groups.  No
task gets a whole source; a hot source spreads over all its groups.

Defined cases: null or blank text has size 0 and no copies, whatever its
place; a very long text is one document like others; a null
source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives an empty result; extra columns pass
through unchanged (columns named like an output column are an error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimledger.llm.common import WORD, materialize, table

#: Hash buckets within a size class of a source (parallelism of a hot source).
BUCKETS = 64
WEIGHTS = (5, 2, 1)
CAP = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size) -> source, source_size, target, rate.

    Sources in code-point order take the weights in turn.  The shares are a
    water level: sources sorted by cap / weight fill up first, and the level
    is the one at the first source that stays below its cap, the highest.  One row per
    source name, so the ordered windows here hold names, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.select("source", "source_size").withColumn("w", weight)
    s = s.withColumn("room", F.col("source_size") * F.lit(float(cap)))
    by_room = Window.orderBy((F.col("room") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
                     / F.sum("w").over(after))
    # the level rises with every source that fills up and falls from the first open one on
    s = s.withColumn("final", F.max("level").over(whole))
    s = s.withColumn("target", F.least(F.col("final") * F.col("w"), F.col("room")))
    return s.select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
                    .alias("rate"))


def mix(docs: DataFrame, size: str = "size", seed: str = "mix", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add source_size, target, copies and taken (words) to ``docs``
    (doc_id, source, and the column ``size``)."""
    s1 = F.col(size) + 1
    d = docs.withColumn("__bits", F.length(F.bin(s1)))
    d = d.withColumn("__class", F.when(s1 < 8, s1).otherwise(
        (F.col("__bits") - 4) * 8 + F.call_function("shiftright", s1, F.col("__bits") - 4)).cast("int"))
    d = d.withColumn("__bucket", F.pmod(_hash32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                                         F.lit(":" + seed))), F.lit(BUCKETS)).cast("int"))
    d = d.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))

    groups = d.groupBy("__key", "__class", "__bucket").agg(
        F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("words"))
    targets = source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__key"),
                             "source_size", "target", "rate")
    before = (Window.partitionBy("__key").orderBy("__class", "__bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (groups.select("__key", "__class", "__bucket",
                             F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
               .join(targets, "__key")
               .withColumn("__u", F.pmod(_hash32(F.concat(F.col("__key"), F.lit(":" + seed))), F.lit(65536)) / 65536.0))

    keys = ["__key", "__class", "__bucket"]
    d = d.join(offsets, keys)
    place = F.col("__before") + F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col(size), F.col("doc_id").asc_nulls_first()))
    d = d.withColumn("__k", place)
    end = F.floor(F.col("__k") * F.col("rate") + F.col("__u"))
    begin = F.floor((F.col("__k") - 1) * F.col("rate") + F.col("__u"))
    d = d.withColumn("copies", F.when(F.col(size) > 0, end - begin).otherwise(F.lit(0)).cast("int"))
    d = d.withColumn("taken", F.col("copies") * F.col(size))
    return d.drop("__bits", "__class", "__bucket", "__key", "__before", "__u", "__k", "rate")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document once per copy."""
    return (mixed.where(F.col("copies") > 0)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix has it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return emit(mix(docs.select(row, "doc_id", "source", word_count(F.col("text")).alias("size")))).select("row.*")


def q_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    # narrow rows, written once: the counts and the numbering read them, not the texts
    return mix(materialize(docs)).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
e AS (
  SELECT *, size + 1 AS s1, length(bin(size + 1)) AS bits,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 8))::BIGINT % {BUCKETS} AS bucket
  FROM d),
f AS (SELECT *, CASE WHEN s1 < 8 THEN s1 ELSE (bits - 4) * 8 + (s1 >> (bits - 4)) END AS cls FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
b AS (
  SELECT a.source, 3.0 * a.source_size / a.w AS mark, sum(least(3.0 * b.source_size, 3.0 * a.source_size / a.w * b.w)) AS held,
    sum(CASE WHEN b.source_size / b.w < a.source_size / a.w THEN 3.0 * b.source_size ELSE 0 END) AS below,
    sum(CASE WHEN b.source_size / b.w >= a.source_size / a.w THEN b.w ELSE 0 END) AS w, sum(b.source_size) AS whole
  FROM w a CROSS JOIN w b GROUP BY a.source, a.source_size, a.w),
v AS (SELECT arg_min((whole - below) / w, mark) AS lvl FROM b WHERE held >= whole),
t AS (SELECT source, source_size, least(3.0 * source_size, lvl * w)::DOUBLE AS target FROM w, v),
n AS (
  SELECT f.doc_id, f.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    (('0x' || substr(md5(coalesce('=' || f.source, '') || ':mix'), 1, 8))::BIGINT % 65536) / 65536.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY f.source ORDER BY cls, bucket, size, doc_id) AS k
  FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT * size)::BIGINT AS taken
FROM n"""
