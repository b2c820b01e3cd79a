"""Derived tables and their build manifests.

A derived table is built once from a raw source with the rules applied; its
manifest pins the fingerprint of the output, of every source it was derived
from, the rule set and the rules fingerprint.  Manifests are rows of a table
(one per build), so freshness of thousands of derived tables is one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.operators.rules import apply_rules
from claimledger.registry import Registry

# Fixed value: the manifest record.
MANIFEST_SCHEMA = ("output string, output_sha256 string, inputs struct<sources: map<string,string>, "
                   "dr_set: array<string>, decisions_fingerprint: string>, built_at string")


def build_daily(df: DataFrame, ts_col: str, rule_ids: list[str], registry: Registry,
                aggs: dict) -> DataFrame:
    """A10: rules applied once, then a small per-day aggregate in a
    deterministic column order and row order (sorted by day)."""
    d = apply_rules(df, rule_ids, registry).withColumn("day", F.date_format(F.col(ts_col), "yyyy-MM-dd"))
    out = d.groupBy("day").agg(*[e.alias(n) for n, e in aggs.items()])
    return out.select("day", *aggs.keys()).orderBy("day")


def manifest_documents(builds: DataFrame, rules_fingerprint: str | None) -> tuple[DataFrame, DataFrame]:
    """(documents, missing).  ``builds`` (output, output_sha256, sources
    map, dr_set, built_at) has one row per derived table; a document pins
    them all.  An output without a fingerprint doesn't exist: it gets no
    manifest and is returned as missing."""
    doc = F.to_json(F.struct(
        "output", "output_sha256",
        F.struct("sources", "dr_set", F.lit(rules_fingerprint).alias("decisions_fingerprint")).alias("inputs"), "built_at"))
    there = F.col("output_sha256").isNotNull()
    return (builds.where(there).select(F.col("output").alias("manifest_id"), doc.alias("doc")),
            builds.where(~there).select("output"))


def load_manifests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests keyed by output, unparsable rows).  ``raw`` holds one
    manifest document per row in column ``doc`` (see manifest_documents);
    rows that do not parse or have no output are returned separately and
    skipped; further columns of ``raw`` pass through."""
    from claimledger.model import FAIL
    # from_json is permissive (a broken document becomes an all-NULL struct),
    # so parseability is decided by try_parse_json
    parsed = (raw.withColumn("_parses", F.expr("try_parse_json(doc)").isNotNull())
                 .withColumn("m", F.from_json("doc", MANIFEST_SCHEMA)))
    good = F.col("_parses") & F.col("m.output").isNotNull()
    ok = parsed.where(good).select(
        *[c for c in raw.columns if c != "doc"], "m.output", "m.output_sha256", "m.inputs.sources", "m.inputs.dr_set",
        F.col("m.inputs.decisions_fingerprint").alias("rules_fingerprint"), "m.built_at")
    bad = parsed.where(~good).select(
        "manifest_id", F.lit("aggregate:freshness").alias("check"), F.lit(FAIL).alias("severity"),
        F.when(~F.col("_parses"), F.lit("manifest does not parse")).otherwise(
            F.lit("manifest has no output field")).alias("detail"))
    return ok, bad
