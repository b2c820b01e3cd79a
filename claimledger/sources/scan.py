"""Scans (A1-A3): tables, raw trees of mixed files, JSON records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimledger.functions.nulls import normalise_nans

# Files never treated as data.
SKIP_SUFFIXES = [".md", ".sha256", ".txt", ".gitkeep"]
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def scan(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A1: read a table and normalise NaN to NULL (one projection)."""
    fmt = fmt or next((f for s, f in FORMATS.items() if path.endswith(s)), "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return normalise_nans(reader.load(path))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """A2: inventory of a raw-data tree: (path, format, rows, cols), one row
    per data file, empty files included.

    Files are listed by Spark (``binaryFile`` without reading content);
    dotfiles and documentation suffixes are skipped, suffixes count in either
    case.  Each format is read in one job over all its files and counted per
    file; ``cols`` is the width of the format's common schema.
    """
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1)))
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
               .select("path").withColumn("name", name)
               .where(~F.col("name").startswith(".")
                      & ~F.lower("name").rlike("(" + "|".join(s.replace(".", r"\.") for s in SKIP_SUFFIXES) + ")$"))
               .withColumn("suffix", suffix))
    there = {r["suffix"] for r in listing.where(F.col("suffix").isin(list(FORMATS))).select("suffix").distinct().collect()}
    tails = []
    for ending, fmt in FORMATS.items():
        if ending not in there:
            continue
        either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ending)
        reader = (spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{either}"))
        if fmt == "csv":
            reader = reader.option("header", "true")
        if fmt == "json":
            reader = reader.option("multiLine", "true")
        df = reader.load(root)
        counts = df.select(F.input_file_name().alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
        files = listing.where(F.col("suffix") == ending).select("path", F.url_decode(F.regexp_replace(
            "path", r"\+", "%2B")).alias("_key"))
        key = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
        strip = lambda c: F.regexp_replace(c, "^file:/+", "/")
        counts = counts.select(strip(key).alias("_path"), "rows")
        tails.append(files.join(counts, strip(F.col("_key")) == F.col("_path"), "left").select(
            "path", F.lit(fmt).alias("format"), F.coalesce("rows", F.lit(0)).alias("rows"),
            F.lit(len(df.columns)).alias("cols")))
    if not tails:
        return spark.createDataFrame([], "path string, format string, rows bigint, cols int")
    return reduce(DataFrame.unionByName, tails)


def exploded_records(df: DataFrame, col: str) -> DataFrame:
    """The other columns of ``df`` and ``_r``, one VARIANT record per row of
    the result.  A value is one record, a list of records, or an object that
    wraps a list of records in one of its fields (the first by name); text
    that doesn't parse is one row of NULL."""
    v = F.call_function("try_parse_json", F.col(f"`{col}`"))
    kind = lambda x: F.call_function("schema_of_variant", x)
    as_list = lambda x: F.call_function("try_variant_get", x, F.lit("$"), F.lit("array<variant>"))
    fields = F.map_entries(F.call_function("try_variant_get", F.col("_v"), F.lit("$"), F.lit("map<string,variant>")))
    lists = F.array_sort(F.transform(F.filter(fields, lambda e: F.coalesce(kind(e["value"]).startswith("ARRAY<OBJECT"), F.lit(False))),
                                     lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("j"))))
    inner = as_list(F.call_function("try_parse_json", F.try_element_at(lists, F.lit(1))["j"]))
    records = (F.when(F.coalesce(kind(F.col("_v")).startswith("ARRAY"), F.lit(False)), as_list(F.col("_v")))
                .when(F.size(lists) > 0, inner).otherwise(F.array(F.col("_v"))))
    rest = [F.col(f"`{c}`") for c in df.columns if c != col]
    return df.withColumn("_v", v).select(*rest, F.explode_outer(records).alias("_r"))


def scan_json_records(df: DataFrame, col: str, schema: str) -> DataFrame:
    """A3: parse a JSON column into the fields of ``schema``, one row per
    record (see ``exploded_records``); text that doesn't parse is one row
    without values."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != col]
    parsed = exploded_records(df, col).select(*rest, F.from_json(F.to_json("_r"), schema).alias("_j"))
    flat = [F.col(f"_j.{f.name}").alias(f.name) for f in parsed.schema["_j"].dataType.fields]
    return parsed.select(*rest, *flat)
