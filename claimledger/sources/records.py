"""JSON records without a given schema (A3) and types of raw values (B1).

``record_schema`` merges the types of all records in one aggregate
(``schema_of_variant_agg``); only the merged type reaches the driver.
``flatten_records`` is then one projection: nested objects become columns
with dotted names, lists stay JSON text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimledger.sources.scan import exploded_records


def _struct(text: str | None) -> T.StructType:
    """The merged type as a struct; what is no object has no fields."""
    if not text or not text.startswith("OBJECT<"):
        return T.StructType()
    # names in backquotes stay as they are
    ddl = "".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<")
                  for p in re.split(r"(`(?:[^`]|``)*`)", text))
    return T._parse_datatype_string(ddl)


def record_schema(df: DataFrame, col: str) -> T.StructType:
    """Merged type of all records of a JSON column: fields that hold values
    of different kinds are VARIANT, fields that are always null VOID."""
    records = exploded_records(df.select(col), col)
    row = records.where(F.call_function("schema_of_variant", F.col("_r")).startswith("OBJECT")).agg(
        F.call_function("schema_of_variant_agg", F.col("_r")).alias("s")).first()
    return _struct(row["s"])


def leaves(schema: T.StructType, above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    out = []
    for f in schema.fields:
        path = (*above, f.name)
        if isinstance(f.dataType, T.StructType) and f.dataType.fields:
            out += leaves(f.dataType, path)
        else:
            out.append((path, f.dataType))
    return out


def _step(name: str) -> str:
    return f'["{name}"]' if "'" in name else f"['{name}']"


def _value(path: tuple[str, ...], dtype: T.DataType) -> Column:
    at = F.lit("$" + "".join(map(_step, path)))
    get = lambda kind: F.call_function("try_variant_get", F.col("_r"), at, F.lit(kind))
    if isinstance(dtype, T.DecimalType):
        return get("double")
    if isinstance(dtype, (T.LongType, T.DoubleType, T.BooleanType, T.StringType)):
        return get(dtype.simpleString())
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    # lists, empty objects and fields of several kinds: strings as they are, all else as JSON
    v = get("variant")
    plain = F.call_function("schema_of_variant", v) == "STRING"
    return F.when(plain, get("string")).when(~F.call_function("is_variant_null", v), F.to_json(v))


def flatten_records(df: DataFrame, col: str, schema: T.StructType | None = None) -> DataFrame:
    """A3: one row per record with a column for every leaf of the merged type,
    named by its dotted path, beside the other columns of ``df``.

    A value is one record, a list of records, or an object that wraps a list
    of records in one of its fields.  Text that doesn't parse and records
    that are no objects give one row without values; a record that lacks a
    field has NULL in its columns.  A field with values of several kinds, such
    as an object here and a number there, is one column of text: strings as
    they are, all else as JSON.  Numbers with a fraction are doubles.  Names
    that meet another column's name get underscores behind them.
    """
    schema = record_schema(df, col) if schema is None else schema
    records = exploded_records(df, col)
    rest = [F.col(f"`{c}`") for c in df.columns if c != col]
    taken, out = {c.lower() for c in df.columns if c != col}, []
    for path, dtype in leaves(schema):
        name = ".".join(path)
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(_value(path, dtype).alias(name))
    return records.select(*rest, *out)


# Types from special to general; a column has the first that holds all its values.
KINDS = ("null", "boolean", "integer", "double", "date", "timestamp", "text")


def kind_of(c: Column) -> Column:
    """Type of one raw text value; empty and blank text is null."""
    t = F.trim(c)
    day = r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
    return (F.when(c.isNull() | (t == ""), "null")
             .when(F.lower(t).isin("true", "false"), "boolean")
             .when(t.rlike(r"^[+-]?\d{1,18}$"), "integer")
             .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "double")
             .when(t.rlike(f"^{day}$"), "date")
             .when(t.rlike(rf"^{day}[ T]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?Z?$"), "timestamp")
             .otherwise("text"))


def sample_types(df: DataFrame, n: int | None = None) -> DataFrame:
    """B1: (column, dtype, rows, nulls, sampled) of raw text columns, from the
    first ``n`` rows or all of them, in one aggregate without a shuffle of
    rows: how many values of each kind a column has decides its type.
    Integers and doubles make double, dates and timestamps timestamp, any
    other mixture text; a column of nulls is null.  ``sampled`` tells whether
    rows beyond the sample exist (one row more is looked for)."""
    rows = df if n is None else df.limit(n)
    more = n is not None and df.limit(n + 1).count() > n
    names = df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    kinds = rows.select(*[kind_of(F.col(f"`{c}`").cast("string")).alias(f"_{i}") for i, c in enumerate(names)])
    for i in range(len(names)):
        aggs += [F.count_if(F.col(f"_{i}") == k).alias(f"_{i}_{k}") for k in KINDS]
    one = kinds.agg(*aggs)

    def dtype(i: int) -> Column:
        has = {k: F.col(f"_{i}_{k}") > 0 for k in KINDS}
        numbers, times = has["integer"] | has["double"], has["date"] | has["timestamp"]
        groups = sum((g.cast("int") for g in (has["boolean"], numbers, times)), F.lit(0))
        return (F.when(has["text"] | (groups > 1), "text").when(has["boolean"], "boolean")
                 .when(has["double"], "double").when(has["integer"], "integer")
                 .when(has["timestamp"], "timestamp").when(has["date"], "date").otherwise("null"))

    entries = F.array(*[F.struct(F.lit(c).alias("column"), dtype(i).alias("dtype"), F.col(f"_{i}_null").alias("nulls"))
                        for i, c in enumerate(names)])
    return one.select("rows", F.lit(more).alias("sampled"), F.inline(entries)).select(
        "column", "dtype", "rows", "nulls", "sampled")
