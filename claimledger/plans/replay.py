"""Replay (D8-D10) and computed registration's shared ``evaluate`` path.

Claims are grouped by (source, rule chain, key column).  All groups over one
source share two jobs: aggregates with the algebraic measures and row counts,
and one table of counted values for quantiles, ranks and units.
Results are joined back to the claims, which stay distributed the whole time:
a ledger with one claim per customer is a join, not a loop.

A group that cannot be evaluated (source gone, rule or key column that does
not fit the source, measure that does not fit or fails while it runs) fails
with its own reason; all other groups are evaluated.

Only the list of distinct groups is collected: (source, chain, key column)
as the ledger's claims use them, at most one per kind of claim.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException,
                            IllegalArgumentException, NumberFormatException, PythonException, SparkRuntimeException)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimledger import model as M
from claimledger.functions.compare import (compare_boolean, compare_distribution,
                                           compare_matrix, compare_scalar, resolve_tolerance)
from claimledger.functions.nulls import normalise_nans
from claimledger.operators.rules import normalise_rule_id
from claimledger.plans.evaluate import analyse, assemble, evaluate, evaluate_groups
from claimledger.registry import Registry
from claimledger.session import materialize

GROUP_COLS = ["source", "fkey", "group_by"]
R_MEASURE_ERROR = "measure_error"
R_RULE_ERROR = "rule_error"
R_KEY_UNKNOWN = "group_key_unknown"
R_UNCLAIMED = "unclaimed_key"

#: Failures that user code or its inputs cause; anything else (a lost
#: cluster, a full disk) ends the batch.
USER_FAULTS = (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException,
               IllegalArgumentException, NumberFormatException, PythonException, SparkRuntimeException)

RESULT_SCHEMA = ("source string, fkey string, group_by string, group_key string, "
                 "measure string, kind string, num double, flag boolean, "
                 "dist map<string,double>, matrix array<array<double>>")
ROWS_SCHEMA = "source string, fkey string, group_by string, group_key string, rows bigint"


def _filters_key(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.regexp_replace(x, "_", "-")), "|")


def precheck(claims: DataFrame, registry: Registry, fingerprints: DataFrame | None = None) -> DataFrame:
    """Add ``pre_reason``: the first reason a claim fails before any data is
    read (registry lookups are Column literals; fingerprints are joined, there
    may be one per partition of a source)."""
    rule_ids = sorted(registry.rules) or ["\x00"]
    measures = sorted(registry.measures) or ["\x00"]
    sources = sorted(registry.sources) or ["\x00"]
    c = claims.withColumn("fkey", _filters_key(F.col("filters")))
    if fingerprints is not None:
        fp = fingerprints.select(F.col("source").alias("_fp_source"), F.col("sha256").alias("_fp_sha"))
        c = c.join(fp, c["source"] == fp["_fp_source"], "left").drop("_fp_source")
    else:
        c = c.withColumn("_fp_sha", F.lit(None).cast("string"))
    ct = F.col("check_type")
    known_rules = F.forall(F.col("filters"),
                           lambda x: F.regexp_replace(x, "_", "-").isin(rule_ids))
    reason = (
        F.when(ct == "manual", F.lit(M.R_MANUAL))
         .when(ct == "quote_provenance", F.lit(None))
         .when(~F.coalesce(F.col("measure").rlike(M.IDENTIFIER_PATTERN), F.lit(False)),
               F.lit(M.R_NOT_CALLABLE))
         .when(~F.col("measure").isin(measures), F.lit(M.R_MEASURE_UNKNOWN))
         .when(F.col("n_sources") != 1, F.lit(M.R_SOURCE_COUNT))
         .when(~F.coalesce(F.col("source").isin(sources), F.lit(False)), F.lit(M.R_SOURCE_MISSING))
         .when(F.col("source_sha256").isNotNull() & F.col("_fp_sha").isNotNull()
               & (F.col("source_sha256") != F.col("_fp_sha")), F.lit(M.R_SOURCE_CHANGED))
         .when(~known_rules, F.lit(M.R_RULE_UNKNOWN)))
    return c.withColumn("pre_reason", reason).drop("_fp_sha")


Group = tuple  # (fkey, group_by, measure names, rule chain)


def _columns_fit(base: DataFrame, group: Group) -> str | None:
    """Why a group's rules or key column don't fit the source (analysis only)."""
    _, group_by, _, chain = group
    try:
        out = reduce(lambda d, r: r.apply(d), chain, base.limit(0))
        out.schema  # noqa: B018 - forces analysis
    except Exception:  # whatever a user's rule raises while its plan is built
        return R_RULE_ERROR
    if group_by and group_by not in out.columns:
        return R_KEY_UNKNOWN
    return None


def _evaluated(base: DataFrame, groups: list[Group], measures: list) -> DataFrame:
    """One stored table with the results and row counts of ``groups``: all
    row-local (fused), or a single group of any rules."""
    if len(groups) == 1 and not all(r.row_local for r in groups[0][3]):
        _, group_by, _, chain = groups[0]
        df = reduce(lambda d, r: r.apply(d), chain, base)
        gk = F.col(group_by).cast("string") if group_by else F.lit(None).cast("string")
        rows, values = evaluate(df.withColumn("_g", F.lit(0)).withColumn("_gk", gk), measures, ["_g", "_gk"])
    else:
        usage: dict[str, list[int]] = {}
        for i, (_, _, names, _) in enumerate(groups):
            for n in names:
                usage.setdefault(n, []).append(i)
        rows, values = evaluate_groups(base, [(chain, gb) for _, gb, _, chain in groups], measures, usage)
    found = assemble(values, measures, ["_g", "_gk"]).withColumn("rows", F.lit(None).cast("long"))
    for name, kind in (("measure", "string"), ("kind", "string"), ("num", "double"), ("flag", "boolean"),
                       ("dist", "map<string,double>"), ("matrix", "array<array<double>>")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    both = materialize(found.unionByName(rows))
    # a group without a key always has a result: over no rows, the measures of an empty frame
    whole = {i for i, g in enumerate(groups) if not g[1]}
    there = {r["_g"] for r in both.where(F.col("rows").isNotNull() & F.col("_g").isin(sorted(whole))).select("_g").collect()} \
        if whole else set()
    if whole - there:
        gone = F.explode(F.array(*[F.lit(i) for i in sorted(whole - there)])).alias("_g")
        _, values = evaluate(base.limit(0), measures)
        empty = assemble(values, measures).withColumn("rows", F.lit(None).cast("long"))
        none = base.sparkSession.range(1).select(F.lit(0).cast("long").alias("rows"))
        none = none.select(*[F.lit(None).cast(both.schema[c].dataType).alias(c) if c != "rows" else F.col(c)
                             for c in both.columns if c not in ("_g", "_gk")])
        empty = empty.unionByName(none).select("*", gone, F.lit(None).cast("string").alias("_gk"))
        both = both.unionByName(materialize(empty))
    gmap = F.array(*[F.struct(F.lit(i).alias("_mg"), F.lit(g[0]).alias("fkey"), F.lit(g[1]).cast("string").alias("group_by"))
                     for i, g in enumerate(groups)])
    return (both.select("*", F.inline(gmap)).where(F.col("_g") == F.col("_mg")).drop("_g", "_mg")
            .withColumnRenamed("_gk", "group_key"))


def compute_groups(spark: SparkSession, groups: list[tuple[str, str, str | None, list[str]]],
                   registry: Registry) -> tuple[DataFrame, DataFrame, dict[tuple, str]]:
    """Evaluate every (source, rule chain, key column) group.

    Groups over one source whose chains are row-local share the jobs
    (``evaluate_groups``); a chain holding a frame-level rule is evaluated
    on its own.  ``groups`` items are (source, fkey, group_by, measure
    names).  Returns (results, rows, broken) where broken maps
    (source, fkey, group_by, measure) to (reason, error text).  A batch that
    fails while it runs is split until the failing group and measure stand
    alone.
    """
    tables: list[DataFrame] = []
    broken: dict[tuple, tuple[str, str]] = {}

    def fail(source: str, group: Group, names: list[str], reason: str, text: str) -> None:
        broken.update({(source, group[0], group[1], n): (reason, text) for n in names})

    def run(source: str, base: DataFrame, members: list[Group], names: list[str]) -> None:
        members = [(f, gb, [n for n in ns if n in names], chain) for f, gb, ns, chain in members]
        members = [m for m in members if m[2]]
        if not members:
            return
        names = sorted({n for m in members for n in m[2]})
        try:
            out = _evaluated(base, members, [registry.measures[n] for n in names])
            tables.append(out.withColumn("source", F.lit(source)))
        except USER_FAULTS as e:
            half = len(members) // 2
            if half:
                run(source, base, members[:half], names)
                run(source, base, members[half:], names)
            elif len(names) > 1:
                run(source, base, members, names[:len(names) // 2])
                run(source, base, members, names[len(names) // 2:])
            else:
                fail(source, members[0], names, R_MEASURE_ERROR, str(e).splitlines()[0])

    by_source: dict[str, list[tuple[str, str | None, list[str]]]] = {}
    for source, fkey, group_by, names in groups:
        by_source.setdefault(source, []).append((fkey, group_by, names))
    for source, items in by_source.items():
        members = [(f, gb, ns, [registry.rules[normalise_rule_id(x)] for x in f.split("|")] if f else [])
                   for f, gb, ns in items]
        try:
            base = normalise_nans(registry.sources[source](spark))
        except Exception as e:  # whatever a user's loader raises: this source is not there
            for m in members:
                fail(source, m, m[2], M.R_SOURCE_MISSING, str(e).splitlines()[0])
            continue
        good, bad = analyse(base, [registry.measures[n] for n in sorted({n for m in members for n in m[2]})])
        fit = []
        for m in members:
            reason = _columns_fit(base, m)
            if reason:
                fail(source, m, m[2], reason, reason)
                continue
            for n in m[2]:
                if n in bad:
                    fail(source, m, [n], R_MEASURE_ERROR, bad[n])
            fit.append(m)
        names = [m.name for m in good]
        fused = [m for m in fit if all(r.row_local for r in m[3])]
        run(source, base, fused, names)
        for m in fit:
            if m not in fused:
                run(source, base, [m], names)
    if not tables:
        return (spark.createDataFrame([], RESULT_SCHEMA), spark.createDataFrame([], ROWS_SCHEMA), broken)
    both = reduce(DataFrame.unionByName, tables)
    return (both.where(F.col("rows").isNull()).select("source", "fkey", "group_by", "group_key", "measure", "kind", "num",
                                                       "flag", "dist", "matrix"),
            # a group whose batch was split by measures is there once per part
            both.where(F.col("rows").isNotNull()).select("source", "fkey", "group_by", "group_key", "rows").distinct(), broken)


def distinct_groups(pending: DataFrame) -> list[tuple[str, str, str | None, list[str]]]:
    """The only collect of claims in replay: distinct (source, chain, key
    column) with their measure names.  Sources, rules and measures are those
    of the registries; one entry per kind of claim, not per claim."""
    g = (pending.groupBy("source", "fkey", "group_by")
                .agg(F.sort_array(F.collect_set("measure")).alias("measures"))
                .orderBy("source", "fkey", "group_by").collect())
    return [(r["source"], r["fkey"], r["group_by"], list(r["measures"])) for r in g]


def replay_keyed(claims: DataFrame, registry: Registry, fingerprints: DataFrame | None = None,
                 corpus: DataFrame | None = None) -> DataFrame:
    """``replay`` with keyed claims matched both ways: a key of the data
    that a project's claims of the same measure, source and rules leave out
    is a FAIL row of its own (``unclaimed_key``), with the id
    ``measure[key]``."""
    return replay(claims, registry, fingerprints, corpus, unclaimed=True)


def replay(claims: DataFrame, registry: Registry, fingerprints: DataFrame | None = None,
           corpus: DataFrame | None = None, unclaimed: bool = False) -> DataFrame:
    """Replay every claim of a typed ledger.

    Output: project, id, check_type, status (PASS / FAIL / AUDIT), reason,
    expected_num, actual_num, expected_rows, rows, error (what a measure,
    rule or source said when it failed).
    """
    spark = claims.sparkSession
    c = materialize(precheck(claims.drop("doc"), registry, fingerprints))
    replayable = F.col("check_type").isin(M.REPLAYABLE_TYPES)
    pending = c.where(F.col("pre_reason").isNull() & replayable)
    groups = distinct_groups(pending)
    results, rows, broken = compute_groups(spark, groups, registry)

    key = [F.col("source"), F.col("fkey"), F.col("group_by"), F.col("group_key")]
    j = c.alias("c")
    rr = rows.alias("rr")
    res = results.alias("res")
    cond_rows = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"rr.{k}"))
                                            for k in ["source", "fkey", "group_by", "group_key"]])
    cond_res = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"res.{k}"))
                                           for k in ["source", "fkey", "group_by", "group_key", "measure"]])
    j = j.join(rr, cond_rows & replayable & F.col("c.pre_reason").isNull(), "left") \
         .join(res, cond_res & replayable & F.col("c.pre_reason").isNull(), "left")
    j = j.select("c.*", F.col("rr.rows").alias("rows"), F.col("res.kind").alias("kind"),
                 F.col("res.num").alias("a_num"), F.col("res.flag").alias("a_flag"),
                 F.col("res.dist").alias("a_dist"), F.col("res.matrix").alias("a_matrix"))

    if broken:
        bk = spark.createDataFrame([(*k, *v) for k, v in broken.items()],
                                   "b_source string, b_fkey string, b_group_by string, b_measure string, "
                                   "b_reason string, error string")
        j = j.join(F.broadcast(bk), (F.col("source") == F.col("b_source")) & (F.col("fkey") == F.col("b_fkey"))
                   & F.col("group_by").eqNullSafe(F.col("b_group_by")) & (F.col("measure") == F.col("b_measure"))
                   & F.col("pre_reason").isNull() & replayable,
                   "left").drop("b_source", "b_fkey", "b_group_by", "b_measure")
    else:
        j = j.withColumn("b_reason", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))

    abs_t, rel_t = resolve_tolerance(F.col("tol_abs"), F.col("tol_rel"))
    ct = F.col("check_type")
    matched = (F.when(ct.isin(M.SCALAR_TYPES),
                      compare_scalar(F.col("value_num"), F.coalesce(F.col("value_str"),
                                     F.col("value_bool").cast("string")), F.col("a_num"), rel_t, abs_t))
                .when(ct == "boolean", compare_boolean(F.col("value_bool"), F.col("a_flag")))
                .when(ct == "distribution", compare_distribution(F.col("distribution"), F.col("a_dist"), rel_t, abs_t))
                .when(ct == "matrix", compare_matrix(F.col("matrix"), F.col("a_matrix"), rel_t, abs_t))
                .otherwise(F.lit(False)))
    if corpus is not None:
        from claimledger.operators.quotes import quote_reasons
        j = quote_reasons(j, corpus)
    else:
        j = j.withColumn("quote_reason", F.lit(M.R_LOCATOR))
    reason = (F.when(F.col("pre_reason").isNotNull(), F.col("pre_reason"))
               .when(ct == "quote_provenance", F.col("quote_reason"))
               .when(~replayable, F.lit(M.R_TYPE))
               .when(F.col("b_reason").isNotNull(), F.col("b_reason"))
               .when(F.col("rows").isNull(), F.lit(M.R_NO_RESULT))
               .when(F.col("row_count").isNotNull() & (F.col("rows") != F.col("row_count")), F.lit(M.R_ROW_COUNT))
               .when(F.col("kind").isNull(), F.lit(M.R_NO_RESULT))
               .when(~matched, F.lit(M.R_VALUE))
               .otherwise(F.lit(M.R_OK)))
    out = j.withColumn("reason", reason)
    status = (F.when(F.col("reason") == M.R_MANUAL, F.lit(M.AUDIT))
               .when(F.col("reason") == M.R_OK, F.lit("PASS")).otherwise(F.lit(M.FAIL)))
    out = out.select("project", "id", "check_type", status.alias("status"), "reason",
                     F.coalesce(F.col("value_num"), F.col("value_bool").cast("double")).alias("expected_num"),
                     F.coalesce(F.col("a_num"), F.col("a_flag").cast("double")).alias("actual_num"),
                     F.col("row_count").alias("expected_rows"), "rows", "error")
    if unclaimed:
        out = out.unionByName(_unclaimed(pending, results))
    return out


def _unclaimed(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Keys of the data without a claim, per project and kind of keyed claim."""
    kind = ["source", "fkey", "group_by", "measure"]
    keyed = pending.where(F.col("group_by").isNotNull())
    claimed = keyed.select("project", *kind, "group_key").distinct()
    kinds = keyed.groupBy("project", *kind).agg(F.first("check_type").alias("check_type"))
    there = results.where(F.col("group_by").isNotNull()).select(
        *kind, "group_key", F.coalesce("num", F.col("flag").cast("double")).alias("actual_num"))
    left = kinds.join(there, kind).alias("a").join(
        claimed.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
                                                       for c in ("project", *kind, "group_key")]), "left_anti")
    return left.select("project", F.concat("measure", F.lit("["), F.coalesce("group_key", F.lit("")), F.lit("]")).alias("id"),
                       "check_type", F.lit(M.FAIL).alias("status"), F.lit(R_UNCLAIMED).alias("reason"),
                       F.lit(None).cast("double").alias("expected_num"), "actual_num",
                       F.lit(None).cast("long").alias("expected_rows"), F.lit(None).cast("long").alias("rows"),
                       F.lit(None).cast("string").alias("error"))


def replay_summary(results: DataFrame) -> DataFrame:
    """Per project, counts by status plus the manual-audit warning."""
    return results.groupBy("project").agg(
        F.count_if(F.col("status") == "PASS").alias("n_pass"),
        F.count_if(F.col("status") == M.FAIL).alias("n_fail"),
        F.count_if(F.col("status") == M.AUDIT).alias("n_audit"),
        F.count(F.lit(1)).alias("n_claims"))


def replay_violations(results: DataFrame) -> DataFrame:
    """Failed replays and one WARN per project counting manual claims."""
    fails = results.where(F.col("status") == M.FAIL).select(
        "project", F.concat(F.lit("replay:"), F.coalesce("id", F.lit(""))).alias("check"), F.lit(M.FAIL).alias("severity"),
        F.col("id").alias("finding_id"), F.col("reason").alias("detail"))
    manual = (results.where(F.col("status") == M.AUDIT).groupBy("project").count()
              .select("project", F.lit("replay:manual_findings").alias("check"), F.lit(M.WARN).alias("severity"),
                      F.lit(None).cast("string").alias("finding_id"),
                      F.format_string("%d finding(s) have check_type=manual", F.col("count")).alias("detail")))
    return fails.unionByName(manual)
