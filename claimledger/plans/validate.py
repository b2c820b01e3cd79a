"""validate(): every check of a portfolio of ledgers in one verdict.

Structural and group checks, document defects, cross-references, freshness,
source sizes, user checks, and, unless ``fast``, schema drift and replay.
Parts whose inputs are not given are left out.  All parts return violation
rows; the verdict is one aggregate over them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger import model as M
from claimledger.operators.checks import VCOLS, extracted, group_checks, structural_checks, user_checks, verdict
from claimledger.operators.contract import SchemaContract, drift_violations, schema_drift
from claimledger.operators.status import freshness, orphan_citations, rule_caveat_sync
from claimledger.plans.replay import replay, replay_violations
from claimledger.registry import Registry
from claimledger.session import materialize
from claimledger.sources.fingerprint import large_source_warnings
from claimledger.sources.ledger_io import document_violations, typed


def contract_violations(ledger: DataFrame, registry: Registry, contracts: dict[str, SchemaContract | Exception]) -> DataFrame:
    """H1 over all locked sources: a lock that could not be read (its error in
    place of a contract) is a FAIL, a source that is not there a WARN, every
    failing constraint of the others a FAIL; for each project alike."""
    spark = ledger.sparkSession
    projects = ledger.select("project").distinct()

    def row(severity: str, detail: str) -> DataFrame:
        return spark.range(1).select(F.lit(severity).alias("severity"), F.lit(detail).alias("detail"))
    parts = []
    for source, contract in sorted(contracts.items()):
        if isinstance(contract, Exception):
            parts.append(row(M.FAIL, f"{source}: the lock can't be read: {contract}"))
            continue
        try:
            df = registry.sources[source](spark)
        except Exception as e:  # a source that isn't registered or whose loader fails is absent
            parts.append(row(M.WARN, f"{source} is not present: {type(e).__name__}"))
            continue
        parts.append(drift_violations(schema_drift(df, contract, source), "").select("severity", "detail"))
    if not parts:
        return spark.createDataFrame([], M.VIOLATIONS_SCHEMA)
    found = reduce(DataFrame.unionByName, parts).withColumn("check", F.lit("schema_drift")).withColumn(
        "finding_id", F.lit(None).cast("string"))
    return projects.crossJoin(F.broadcast(found)).select(*VCOLS)  # a row per contract column at most


def validate(ledger: DataFrame, registry: Registry, *, memo: DataFrame | None = None, caveats: DataFrame | None = None,
             implemented: DataFrame | None = None, statuses: DataFrame | None = None,
             manifests: DataFrame | None = None, current: DataFrame | None = None, sizes: DataFrame | None = None,
             contracts: dict[str, SchemaContract | Exception] | None = None, fingerprints: DataFrame | None = None,
             corpus: DataFrame | None = None, fast: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(violations, verdict) of ``ledger`` (project, doc).

    ``fast`` leaves out what reads the sources (drift, replay) and makes
    stale aggregates warnings; ``strict`` lets warnings fail the verdict.
    """
    claims, columns = typed(ledger), extracted(ledger)
    parts = [document_violations(ledger), structural_checks(columns, sorted(registry.measures)), group_checks(columns),
             user_checks(ledger, registry.checks)]
    if memo is not None:
        parts.append(orphan_citations(claims, memo))
    if caveats is not None and implemented is not None and statuses is not None:
        parts.append(rule_caveat_sync(caveats, implemented, statuses, fast))
    if manifests is not None and current is not None:
        parts.append(freshness(manifests, current, registry.rules_fingerprint(), fast))
    if sizes is not None:
        parts.append(large_source_warnings(claims, sizes))
    if not fast:
        if contracts:
            parts.append(contract_violations(ledger, registry, contracts))
        # documents that hold no finding at all are reported as such, not replayed
        there = claims.where(F.coalesce("id", "claim", "check_type", "code_path").isNotNull())
        parts.append(replay_violations(replay(there, registry, fingerprints, corpus)))
    found = materialize(reduce(DataFrame.unionByName, [p.select(*VCOLS) for p in parts]))
    return found, verdict(found, ledger, strict)
