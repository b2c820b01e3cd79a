"""Ledger checks.

Row-local checks fuse into ONE projection that builds an array of violation
structs per finding, followed by one ``inline``; group checks are aggregates
keyed by project.  Output rows: (project, check, severity, finding_id, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger import model as M
from claimledger.session import materialize
from claimledger.sources.ledger_io import get, is_array, is_number, is_object, parse, vtype

VCOLS = ["project", "check", "severity", "finding_id", "detail"]


def _viol(cond: Column, check: str, severity: str, detail: Column | str) -> Column:
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(F.coalesce(cond, F.lit(False)),
                  F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                           d.cast("string").alias("detail")))


# JSON paths whose type tag / value the checks read; each is extracted once
# per finding into a column, then every check reads columns.
_TAG_PATHS = {
    "id": "$.id", "claim": "$.claim", "check_type": "$.check_type", "code_path": "$.code_path",
    "input": "$.input", "reproducibility": "$.reproducibility", "caveats": "$.caveats",
    "counterfactual_tag": "$.counterfactual_tag", "revision_history": "$.revision_history",
    "value": "$.value", "distribution": "$.distribution", "matrix": "$.matrix",
    "quote": "$.quote", "source_locator": "$.source_locator", "measurement_ref": "$.measurement_ref",
    "columns": "$.input.columns", "sources": "$.input.sources", "filters": "$.reproducibility.filters",
    "row_count": "$.reproducibility.row_count_after_filter", "tolerance": "$.tolerance",
    "tol_abs": "$.tolerance.abs", "tol_rel": "$.tolerance.rel",
}


def _extract(p: DataFrame) -> DataFrame:
    """One projection: a type tag per path plus the few typed values."""
    def size(path: str) -> Column:
        return F.expr(f"array_size(try_variant_get(v, '{path}', 'array<variant>'))")
    return p.select(
        "project",
        *[vtype(path).alias(f"t_{name}") for name, path in _TAG_PATHS.items()],
        get("$.id", "string").alias("s_id"), get("$.check_type", "string").alias("s_ct"),
        get("$.code_path", "string").alias("s_cp"), get("$.counterfactual_tag", "string").alias("s_tag"),
        get("$.quote", "string").alias("s_quote"), get("$.source_locator", "string").alias("s_locator"),
        get("$.measurement_ref", "string").alias("s_mref"),
        get("$.tolerance.abs", "double").alias("d_tol_abs"), get("$.tolerance.rel", "double").alias("d_tol_rel"),
        get("$.value", "double").alias("d_value"),
        size("$.matrix").alias("n_matrix"), size("$.revision_history").alias("n_rev"),
        size("$.caveats").alias("n_caveats"), size("$.input.sources").alias("n_sources"),
        F.col("v").isNotNull().alias("is_finding"),
        F.transform(F.expr("try_variant_get(v, '$.input.sources', 'array<variant>')"), _source).alias("a_sources"))


def _source(s: Column) -> Column:
    """(path, sha) of an input source; a path that is no string is NULL."""
    field = lambda name, kind: F.call_function("try_variant_get", s, F.lit(f"$.{name}"), F.lit(kind))
    kind = F.call_function("schema_of_variant", field("path", "variant"))
    return F.struct(F.when(kind == "STRING", field("path", "string")).alias("path"), field("sha256", "string").alias("sha"))


def extracted(ledger: DataFrame) -> DataFrame:
    """The narrow columns that all checks read, extracted from the documents
    once and stored; both check functions take it in place of a ledger."""
    return materialize(_extract(_objects(ledger)))


def _columns(ledger: DataFrame) -> DataFrame:
    return ledger if "is_finding" in ledger.columns else _extract(_objects(ledger))


def _t(name: str) -> Column:
    return F.col(f"t_{name}")


def _absent(name: str) -> Column:
    return _t(name).isNull()


def _missing_or_null(name: str) -> Column:
    return _t(name).isNull() | (_t(name) == "VOID")


def _falsy_str(name: str, value: Column) -> Column:
    """Absent, JSON null or an empty string."""
    return _missing_or_null(name) | F.coalesce(value == "", F.lit(False))


def _tol_bad(name: str, cap: float, loose: bool) -> Column:
    t, val = _t(name), F.col(f"d_{name}")
    present = is_object(_t("tolerance")) & t.isNotNull() & (t != "VOID")
    if loose:
        return present & is_number(t) & (val >= 0) & (val > cap)
    return present & (~is_number(t) | (val < 0))


def _tolerance_fails() -> Column:
    return (_t("tolerance").isNotNull() & (_t("tolerance") != "VOID") & ~is_object(_t("tolerance"))) \
        | _tol_bad("tol_abs", M.MAX_ABS_TOL, False) | _tol_bad("tol_abs", M.MAX_ABS_TOL, True) \
        | _tol_bad("tol_rel", M.MAX_REL_TOL, False) | _tol_bad("tol_rel", M.MAX_REL_TOL, True)


def _objects(ledger: DataFrame) -> DataFrame:
    """Non-objects get a NULL variant rather than being filtered out: a
    filter on ``v`` would be pushed below the parse and copy it."""
    p = parse(ledger) if "v" not in ledger.columns else ledger
    return p.withColumn("v", F.when(is_object(F.expr("schema_of_variant(v)")), F.col("v")))


def structural_checks(ledger: DataFrame, measure_names: list[str] | None = None) -> DataFrame:
    """F1, F2, F4-F8, F10-F18 (row-local) for every well-formed finding."""
    x = _columns(ledger)
    fid, ct, tag = F.col("s_id"), F.col("s_ct"), F.col("s_tag")
    replayable = F.coalesce(ct.isin(M.REPLAYABLE_TYPES), F.lit(False))
    cp = F.when(_t("code_path") == "STRING", F.col("s_cp")).otherwise(F.lit(""))
    has_colon = cp.contains(":")
    cp_file = F.when(has_colon, F.expr(
        "substring(s_cp, 1, length(s_cp) - length(substring_index(s_cp, ':', -1)) - 1)")).otherwise(F.lit(""))
    suffix = F.substring_index(cp, ":", -1)
    escapes = cp_file.startswith("/") | cp_file.rlike(r"(^|/)\.\.(/|$)")
    line_ref = suffix.rlike(M.LINE_REF_PATTERN)
    callable_ = ~line_ref & suffix.rlike(M.IDENTIFIER_PATTERN)
    names = measure_names if measure_names is not None else []
    resolves = suffix.isin(names) if names else F.lit(False)
    id_missing = _missing_or_null("id") | F.coalesce(fid == "", F.lit(False))
    n_src = F.col("n_sources")
    file_ok = has_colon & (cp_file != "")

    source_ok = lambda x: F.coalesce(x["path"] != "", F.lit(False))

    viols = [
        _viol(id_missing, "ids:present", M.FAIL, "missing id"),
        _viol(~id_missing & ~fid.rlike(M.ID_PATTERN), "ids:format", M.FAIL, fid),
        *[_viol(_absent(f), "schema:required", M.FAIL, f) for f in M.REQUIRED_FIELDS],
        _viol(~F.coalesce(ct.isin(M.CHECK_TYPES), F.lit(False)), "check_type:valid", M.FAIL,
              F.coalesce(ct, F.lit("null"))),
        _viol(ct.isin(M.SCALAR_TYPES) & _missing_or_null("value"), "conditional:value", M.FAIL, ct),
        _viol((ct == "boolean") & ~F.coalesce(_t("value") == "BOOLEAN", F.lit(False)),
              "conditional:value", M.FAIL, ct),
        _viol((ct == "distribution") & ~(is_object(_t("distribution"))
                                         & ~F.coalesce(_t("distribution") == "OBJECT<>", F.lit(False))),
              "conditional:distribution", M.FAIL, ct),
        _viol((ct == "matrix") & ~(is_array(_t("matrix")) & F.coalesce(F.col("n_matrix") > 0, F.lit(False))),
              "conditional:matrix", M.FAIL, ct),
        _viol((ct == "quote_provenance") & (_falsy_str("quote", F.col("s_quote"))
                                            | _falsy_str("source_locator", F.col("s_locator"))),
              "conditional:quote", M.FAIL, ct),
        _viol(~F.coalesce(tag.isin(M.TAGS), F.lit(False)), "counterfactual:valid", M.FAIL,
              F.coalesce(tag, F.lit("null"))),
        _viol(F.coalesce(tag == "OBSERVED", F.lit(False)) & _falsy_str("measurement_ref", F.col("s_mref")),
              "counterfactual:observed_needs_ref", M.FAIL, "OBSERVED"),
        _viol(~has_colon, "code_path:form", M.FAIL, cp),
        _viol(has_colon & (cp_file == ""), "code_path:nonempty", M.FAIL, cp),
        _viol(file_ok & escapes, "code_path:escapes", M.FAIL, cp),
        _viol(file_ok & ~escapes & callable_ & ~resolves, "code_path:resolves", M.FAIL, cp),
        _viol(file_ok & ~escapes & ~line_ref & ~callable_, "code_path:form", M.FAIL, cp),
        _viol(file_ok & ~escapes & line_ref & replayable, "code_path:line_ref", M.FAIL, cp),
        _viol(~(is_array(_t("revision_history")) & F.coalesce(F.col("n_rev") > 0, F.lit(False))),
              "revision_history:nonempty", M.FAIL, "empty"),
        _viol(~is_array(_t("caveats")), "caveats:list", M.FAIL, "not a list"),
        _viol(is_array(_t("caveats")) & F.coalesce(F.col("n_caveats") == 0, F.lit(False)),
              "caveats:empty", M.WARN, "empty"),
        _viol(~is_object(_t("input")), "input:shape", M.FAIL, "not an object"),
        _viol(is_object(_t("input")) & _absent("columns"), "input:columns", M.FAIL, "missing"),
        _viol(is_object(_t("input")) & ~(is_array(_t("sources")) & F.coalesce(n_src > 0, F.lit(False))),
              "input:sources", M.FAIL, "empty"),
        _viol(is_object(_t("input")) & is_array(_t("sources")) & F.coalesce(n_src > 0, F.lit(False))
              & replayable & (n_src != 1), "input:single_source", M.FAIL, n_src.cast("string")),
        _viol(~is_object(_t("reproducibility")), "reproducibility:shape", M.FAIL, "not an object"),
        _viol(is_object(_t("reproducibility")) & ~is_array(_t("filters")),
              "reproducibility:filters", M.FAIL, "not a list"),
        _viol(is_object(_t("reproducibility")) & replayable & _absent("row_count"),
              "reproducibility:row_count", M.FAIL, "missing"),
        _viol(_t("tolerance").isNotNull() & (_t("tolerance") != "VOID") & ~is_object(_t("tolerance")),
              "tolerance:shape", M.FAIL, "not an object"),
        _viol(_tol_bad("tol_abs", M.MAX_ABS_TOL, False), "tolerance:value", M.FAIL, "abs"),
        _viol(_tol_bad("tol_abs", M.MAX_ABS_TOL, True), "tolerance:loose", M.FAIL, "abs"),
        _viol(_tol_bad("tol_rel", M.MAX_REL_TOL, False), "tolerance:value", M.FAIL, "rel"),
        _viol(_tol_bad("tol_rel", M.MAX_REL_TOL, True), "tolerance:loose", M.FAIL, "rel"),
    ]
    src_viol = F.transform(
        F.when(is_object(_t("input")) & is_array(_t("sources")),
               F.filter(F.col("a_sources"), lambda s: ~source_ok(s))),
        lambda s: F.struct(F.lit("input:sources").alias("check"), F.lit(M.FAIL).alias("severity"),
                           F.lit("source without a string path").alias("detail")))
    empty = F.array().cast("array<struct<check:string,severity:string,detail:string>>")
    # Several medium-sized array columns instead of one huge expression: each
    # compiles to its own method (one giant expression exceeds the JVM method
    # size limit and falls back to interpreted evaluation).
    chunk = 8
    parts = [F.filter(F.array(*viols[i:i + chunk]), lambda x: x.isNotNull()).alias(f"_c{i // chunk}")
             for i in range(0, len(viols), chunk)]
    parts.append(F.coalesce(src_viol, empty).alias("_src"))
    names = [f"_c{i // chunk}" for i in range(0, len(viols), chunk)] + ["_src"]
    staged = x.select("project", "is_finding", fid.alias("finding_id"), *parts)
    arr = F.when(F.col("is_finding"), F.concat(*[F.col(n) for n in names])).otherwise(empty)
    return staged.select("project", "finding_id", F.inline(arr)).select(*VCOLS)


def group_checks(ledger: DataFrame) -> DataFrame:
    """F3, F9, F18 (custom tolerance count), F19, F20 as aggregates per
    project, all from one stored extraction of the findings."""
    x = (ledger if "is_finding" in ledger.columns else extracted(ledger)).where("is_finding")
    dup = (x.where(F.col("s_id").isNotNull() & (F.col("s_id") != ""))
            .groupBy("project", F.col("s_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select("project", F.lit("ids:unique").alias("check"), F.lit(M.FAIL).alias("severity"),
                    F.col("id").alias("finding_id"),
                    F.format_string("duplicate id %s (%d copies)", F.col("id"), F.col("n")).alias("detail")))
    # tolerance flags are computed in a projection and aggregated as plain
    # booleans, which keeps the aggregate small enough to compile
    flags = x.select("project", (F.col("s_tag") == "OBSERVED").alias("_obs"),
                     is_object(_t("tolerance")).alias("_custom"), _tolerance_fails().alias("_bad"))
    per = flags.groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_obs")).alias("n_obs"),
        F.count_if(F.col("_custom")).alias("n_custom"), F.count_if(F.col("_bad")).alias("n_bad"))
    obs = (per.where((F.col("n_obs") / F.col("n") > M.OBSERVED_SHARE_LIMIT) & (F.col("n") > M.OBSERVED_MIN_FINDINGS))
              .select("project", F.lit("counterfactual:tag_distribution").alias("check"),
                      F.lit(M.WARN).alias("severity"), F.lit(None).cast("string").alias("finding_id"),
                      F.format_string("%d/%d are OBSERVED", F.col("n_obs"), F.col("n")).alias("detail")))
    # custom tolerance WARN: only when the project has no tolerance FAIL
    custom = (per.where((F.col("n_custom") > 0) & (F.col("n_bad") == 0))
                 .select("project", F.lit("tolerance:custom").alias("check"), F.lit(M.WARN).alias("severity"),
                         F.lit(None).cast("string").alias("finding_id"),
                         F.format_string("%d finding(s) use a custom replay tolerance",
                                         F.col("n_custom")).alias("detail")))
    src = x.select("project", F.inline("a_sources"))
    src = src.where(F.col("path").isNotNull())
    per_src = src.groupBy("project", "path").agg(
        F.count_distinct(F.when(F.col("sha") != "", F.col("sha"))).alias("n_sha"),
        F.count_if(F.coalesce(F.col("sha"), F.lit("")) == "").alias("n_unpinned"))
    incons = per_src.where("n_sha > 1").select(
        "project", F.lit("source_hash:consistency").alias("check"), F.lit(M.FAIL).alias("severity"),
        F.lit(None).cast("string").alias("finding_id"),
        F.format_string("findings disagree on the fingerprint of %s", F.col("path")).alias("detail"))
    unpinned = (per_src.groupBy("project").agg(F.sum("n_unpinned").alias("u"),
                                                 F.max(F.col("n_sha") > 1).alias("bad"))
                .where((F.col("u") > 0) & ~F.col("bad"))
                .select("project", F.lit("source_hash:unpinned").alias("check"), F.lit(M.WARN).alias("severity"),
                        F.lit(None).cast("string").alias("finding_id"),
                        F.format_string("%d input source(s) have no pinned fingerprint", F.col("u")).alias("detail")))
    return reduce(DataFrame.unionByName, [dup, obs, custom, incons, unpinned])


def user_checks(ledger: DataFrame, checks: dict) -> DataFrame:
    """union of user-registered checks (each ledger -> violations)."""
    spark = ledger.sparkSession
    parts = [fn(ledger).select(*VCOLS) for fn in checks.values()]
    if not parts:
        return spark.createDataFrame([], M.VIOLATIONS_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def verdict(violations: DataFrame, projects: DataFrame, strict: bool = False) -> DataFrame:
    """one row per project: failures, warnings, exit code."""
    counts = violations.groupBy("project").agg(
        F.count_if(F.col("severity") == M.FAIL).alias("failures"),
        F.count_if(F.col("severity") == M.WARN).alias("warnings"))
    v = projects.select("project").distinct().join(counts, "project", "left").fillna(0, ["failures", "warnings"])
    code = F.when(F.col("failures") > 0, 1).when(F.lit(strict) & (F.col("warnings") > 0), 1).otherwise(0)
    return v.select("project", F.col("failures").cast("long"), F.col("warnings").cast("long"),
                    code.alias("exit_code"))
