"""Schema contracts: drift, coercion, ranges, nulls, uniqueness, quarantine
(H1-H7) and schema locks (A11).

A contract is code-sized (one entry per column).  Checking it is one
aggregate pass for the row-local constraints plus one grouped count per
unique column; quarantine is a projection that carries the reasons.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimledger import model as M


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    dtype: str                 # Spark SQL type name used for coercion
    nullable: bool = True
    unique: bool = False
    ge: float | None = None
    le: float | None = None


@dataclass(frozen=True)
class SchemaContract:
    columns: tuple[ColumnSpec, ...]
    strict: str = "filter"     # undeclared columns are dropped
    coerce: bool = True

    def names(self) -> list[str]:
        return [c.name for c in self.columns]


LOCK_SCHEMA = ("source string, column string, dtype string, nullable boolean, unique boolean, "
               "ge double, le double")


def lock_rows(spark: SparkSession, contract: SchemaContract, source: str) -> DataFrame:
    return spark.createDataFrame([(source, c.name, c.dtype, c.nullable, c.unique,
                                   None if c.ge is None else float(c.ge), None if c.le is None else float(c.le))
                                  for c in contract.columns], LOCK_SCHEMA)


def lock_schema(locks: DataFrame, contract: SchemaContract, source: str) -> DataFrame:
    """Upsert the contract of ``source`` into the lock table (anti-join
    the old rows of that source, union the new ones)."""
    new = lock_rows(locks.sparkSession, contract, source)
    return locks.where(F.col("source") != source).unionByName(new)


def contract_from_locks(locks_rows: list) -> SchemaContract:
    """Rebuild a contract from collected lock rows of ONE source (code-sized)."""
    return SchemaContract(tuple(ColumnSpec(r["column"], r["dtype"], r["nullable"], r["unique"], r["ge"], r["le"])
                                for r in locks_rows))


def _coerced(df: DataFrame, c: ColumnSpec, coerce: bool) -> Column:
    col = F.col(f"`{c.name}`")
    return col.try_cast(c.dtype) if coerce else col


def reasons(df: DataFrame, contract: SchemaContract) -> Column:
    """Array of every constraint a row breaks (empty when it conforms)."""
    present = set(df.columns)
    out = []
    for c in contract.columns:
        if c.name not in present:
            continue
        raw = F.col(f"`{c.name}`")
        v = _coerced(df, c, contract.coerce)
        out.append(F.when(raw.isNotNull() & v.isNull(), F.lit(f"{c.name}:coerce")))
        if not c.nullable:
            out.append(F.when(raw.isNull(), F.lit(f"{c.name}:nullable")))
        if c.ge is not None:
            out.append(F.when(v < F.lit(c.ge), F.lit(f"{c.name}:ge")))
        if c.le is not None:
            out.append(F.when(v > F.lit(c.le), F.lit(f"{c.name}:le")))
    if not out:
        return F.array().cast("array<string>")
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def schema_drift(df: DataFrame, contract: SchemaContract, source: str) -> DataFrame:
    """H1-H6: (source, check, column, failures) - every failing constraint
    with its count (lazy: all of them, not the first)."""
    spark = df.sparkSession
    present = set(df.columns)
    missing = [c.name for c in contract.columns if c.name not in present]
    parts = []
    if missing:
        parts.append(spark.createDataFrame([(source, "missing_column", m, 1) for m in missing],
                                           "source string, check string, column string, failures bigint"))
    aggs, labels = [], []
    for c in contract.columns:
        if c.name not in present:
            continue
        raw = F.col(f"`{c.name}`")
        v = _coerced(df, c, contract.coerce)
        aggs.append(F.count_if(raw.isNotNull() & v.isNull()).alias(f"_{len(labels)}"))
        labels.append(("coerce", c.name))
        if not c.nullable:
            aggs.append(F.count_if(raw.isNull()).alias(f"_{len(labels)}"))
            labels.append(("nullable", c.name))
        if c.ge is not None:
            aggs.append(F.count_if(v < F.lit(c.ge)).alias(f"_{len(labels)}"))
            labels.append(("ge", c.name))
        if c.le is not None:
            aggs.append(F.count_if(v > F.lit(c.le)).alias(f"_{len(labels)}"))
            labels.append(("le", c.name))
    if aggs:
        row = df.agg(*aggs)
        parts.append(row.select(F.inline(F.array(*[
            F.struct(F.lit(source).alias("source"), F.lit(chk).alias("check"), F.lit(col).alias("column"),
                     F.col(f"_{i}").cast("long").alias("failures")) for i, (chk, col) in enumerate(labels)]))))
    for c in contract.columns:
        if c.unique and c.name in present:
            dups = (df.where(F.col(f"`{c.name}`").isNotNull()).groupBy(f"`{c.name}`").count()
                      .where("count > 1").agg(F.count(F.lit(1)).alias("failures")))
            parts.append(dups.select(F.lit(source).alias("source"), F.lit("unique").alias("check"),
                                     F.lit(c.name).alias("column"), F.col("failures").cast("long")))
    out = reduce(DataFrame.unionByName, parts)
    return out.where(F.col("failures") > 0)


def drift_violations(drift: DataFrame, project: str) -> DataFrame:
    """H1 as violations: one FAIL per failing constraint."""
    return drift.select(F.lit(project).alias("project"), F.lit("schema_drift").alias("check"),
                        F.lit(M.FAIL).alias("severity"), F.lit(None).cast("string").alias("finding_id"),
                        F.format_string("%s: %s %s failed on %d row(s)", F.col("source"), F.col("column"),
                                        F.col("check"), F.col("failures")).alias("detail"))


def quarantine(df: DataFrame, contract: SchemaContract) -> tuple[DataFrame, DataFrame]:
    """H2 + H7: (good, bad).  Good rows keep only declared columns, coerced;
    bad rows carry ``reasons``.  Uniqueness is not row-local and is
    reported by ``schema_drift`` instead."""
    present = [c for c in contract.columns if c.name in set(df.columns)]
    tagged = df.withColumn("reasons", reasons(df, contract))
    cols = [_coerced(df, c, contract.coerce).alias(c.name) for c in present]
    good = tagged.where(F.size("reasons") == 0).select(*cols)
    bad = tagged.where(F.size("reasons") > 0)
    return good, bad


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """H6: (columns..., copies) for every key that more than one row has.
    Parts of a composite key may be NULL and NULLs are equal; a row whose key
    is NULL throughout has none.  Partial counts, no bound on the keys."""
    key = [F.col(f"`{c}`") for c in columns]
    there = reduce(lambda a, b: a | b, [c.isNotNull() for c in key])
    return df.where(there).groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def quarantine_duplicates(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """H6 + H7: (good, bad): all copies of a duplicated key are bad.  A join
    on the key, so a key with very many copies is split like any skewed one."""
    dups = duplicate_keys(df, columns).select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(columns)])
    return df.join(dups, same, "left_anti"), df.join(dups, same, "left_semi")
