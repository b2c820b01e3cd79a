"""Cross-references, lineage, freshness and status.

Every operator is keyed by ``project`` so one run covers a portfolio of
ledgers, registers and manifests.  Inputs are DataFrames: the typed ledger,
replay results, register documents, manifests, current fingerprints.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimledger import model as M
from claimledger.operators.textops import parts
from claimledger.session import materialize

VCOLS = ["project", "check", "severity", "finding_id", "detail"]


def _v(df: DataFrame, check: str, severity, finding_id: Column | None, detail: Column) -> DataFrame:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select("project", F.lit(check).alias("check"), sev.alias("severity"),
                     (finding_id if finding_id is not None else F.lit(None).cast("string")).alias("finding_id"),
                     detail.alias("detail"))


# -- G1 / G2 -------------------------------------------------------------------

def _violation(test: Column, check: str, severity: str, finding_id: Column | None, detail: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.when(F.coalesce(test, F.lit(False)), F.struct(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        (finding_id if finding_id is not None else none).alias("finding_id"), detail.alias("detail")))


def orphan_citations(ledger: DataFrame, memo: DataFrame) -> DataFrame:
    """G1: ids cited in the memo but absent from the ledger; G2: abandonment
    WARN when the highest known id outruns the highest cited by more than
    ten - evaluated only for projects without orphans.  Projects without a
    memo get one WARN and are skipped.

    Ledger and memo are read once: one row per (project, id) says where the
    id stands, and both tests read these rows."""
    yes, no = F.lit(True), F.lit(False)
    ids = F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(M.ID_IN_TEXT), 0)))
    both = ledger.select("project", "id", F.col("id").isNotNull().alias("known"), no.alias("cited"), yes.alias("here"),
                         no.alias("memo")).unionAll(
        memo.select("project", ids.alias("id")).select("project", "id", no, F.col("id").isNotNull(), no, yes))
    rows = materialize(both.groupBy("project", "id").agg(*[F.bool_or(c).alias(c) for c in ("known", "cited", "here", "memo")]))
    orphan = F.col("cited") & ~F.col("known")
    number = F.regexp_extract("id", r"^F-(\d+)", 1).try_cast("long")
    per = rows.groupBy("project").agg(
        F.max(F.when(F.col("known"), number)).alias("kmax"), F.max(F.when(F.col("cited"), number)).alias("cmax"),
        F.bool_or(orphan).alias("orphans"), F.bool_or("here").alias("here"), F.bool_or("memo").alias("memo"))
    g1 = rows.select("project", F.inline(F.array_compact(F.array(_violation(
        orphan, "trust_memo:orphans", M.FAIL, F.col("id"), F.concat(F.lit("memo cites unknown "), F.col("id")))))))
    g2 = per.select("project", F.inline(F.array_compact(F.array(
        _violation(~F.col("orphans") & (F.col("kmax") - F.col("cmax") > M.ABANDONMENT_GAP), "trust_memo:abandonment", M.WARN,
                   None, F.format_string("highest finding F-%03d but memo cites only up to F-%03d", F.col("kmax"), F.col("cmax"))),
        _violation(F.col("here") & ~F.col("memo"), "trust_memo:exists", M.WARN, None,
                   F.lit("no memo - orphan check skipped"))))))
    return g1.unionByName(g2).select(*VCOLS)


# -- G3 --------------------------------------------------------------------------

def rule_caveat_sync(caveats: DataFrame, implemented: DataFrame, statuses: DataFrame, fast: bool) -> DataFrame:
    """G3 per project.  ``caveats``: (project, text) register documents;
    ``implemented``: (project, id) rules with an implementation;
    ``statuses``: (project, id, status).  Dormant for a project while its
    register still holds the placeholder token.

    Every input is read once, into one row per (project, rule)."""
    sev = M.WARN if fast else M.FAIL
    no, none = F.lit(False), F.lit(None).cast("string")
    found = F.posexplode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(M.RULE_ID_IN_TEXT), 0))).alias("_pos", "id")
    c = caveats.select("project", F.col("text").contains(M.PLACEHOLDER_TOKEN).alias("unfilled"),
                       F.regexp_count("text", F.lit(M.PENDING_PATTERN)).alias("pending"), found)
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0  # a document's own figures count once
    rows = c.select("project", "id", F.col("id").isNotNull().alias("ref"), no.alias("impl"), none.alias("status"),
                    F.lit(True).alias("doc"), "unfilled", F.when(first, F.col("pending")).otherwise(0).alias("pending"))
    rows = rows.unionAll(implemented.select("project", "id", no, F.lit(True), none, no, no, F.lit(0)))
    rows = rows.unionAll(statuses.select("project", "id", no, no, "status", no, no, F.lit(0)))
    rows = materialize(rows.groupBy("project", "id").agg(
        F.bool_or("ref").alias("ref"), F.bool_or("impl").alias("impl"), F.max("status").alias("status"),
        F.bool_or("doc").alias("doc"), F.bool_or("unfilled").alias("unfilled"), F.sum("pending").alias("pending")))
    per = (rows.groupBy("project").agg(F.bool_or("doc").alias("_doc"), F.bool_or("unfilled").alias("_unfilled"),
                                       F.sum("pending").alias("n")).where("_doc AND NOT _unfilled").select("project", "n"))
    retired = F.coalesce(F.col("status").isin(M.RETIRED_RULE_STATUSES), no)
    check, rid, ref, impl = "decisions_caveats:sync", F.col("id"), F.col("ref"), F.col("impl")
    sync = rows.join(per, "project").select("project", F.inline(F.array_compact(F.array(
        _violation(ref & ~impl, check, sev, rid, F.concat(F.lit("caveats cite "), rid, F.lit(" but it has no implementation"))),
        _violation(ref & impl & retired, check, sev, rid, F.concat(F.lit("caveats cite "), rid, F.lit(" but it is "),
                                                                  F.col("status"))),
        _violation(impl & ~ref & ~retired, check, sev, rid, F.concat(rid, F.lit(" is active but not in the caveats register")))))))
    pending = per.where("n > 0")
    return sync.select(*VCOLS).unionByName(_v(pending, "decisions_caveats:pending", M.WARN, None, F.format_string(
        "%d caveat(s) still marked pending", F.col("n").cast("int"))))


# -- G4 / G5 ---------------------------------------------------------------------

def lineage(claims: DataFrame, manifests: DataFrame) -> DataFrame:
    """Claim -> derived table -> raw sources, rule set, build time.
    Claims whose source is not a derived output keep one row with NULLs."""
    c = claims.select("project", "id", F.explode_outer("sources").alias("s")).select(
        "project", "id", F.col("s.path").alias("source"))
    m = manifests.select(F.col("output").alias("source"), "sources", "dr_set", "built_at")
    j = c.join(m, "source", "left")
    return j.select("project", "id", "source", F.explode_outer(F.map_entries("sources")).alias("e"),
                    F.array_join("dr_set", ",").alias("dr_set"), "built_at").select(
        "project", "id", "source", F.col("e.key").alias("raw_source"), F.col("e.value").alias("raw_sha256"),
        "dr_set", "built_at")


def freshness(manifests: DataFrame, current: DataFrame, rules_fingerprint: str | None, fast: bool) -> DataFrame:
    """Every manifest against the current fingerprints.

    ``manifests``: (project, output, output_sha256, sources map, dr_set,
    rules_fingerprint); ``current``: (path, sha256) for what exists now.
    A missing output stops that manifest's other tests; an absent source is
    only a WARN (cannot verify); a changed rule set marks it stale.
    """
    sev = M.WARN if fast else M.FAIL
    now = lambda key, name: current.select(F.col("path").alias(key), F.col("sha256").alias(name))
    # one row per manifest and source (one where there is none); the tests of
    # the manifest itself go with its first row
    m = manifests.join(now("_op", "_out"), F.col("output") == F.col("_op"), "left")
    m = m.select("*", F.posexplode_outer(F.map_entries("sources")).alias("_pos", "_s"))
    m = m.withColumn("_source", F.col("_s.key")).withColumn("_pin", F.col("_s.value"))
    m = m.join(now("_sp", "_now"), F.col("_source") == F.col("_sp"), "left")
    first, there = F.coalesce(F.col("_pos"), F.lit(0)) == 0, F.col("_out").isNotNull()
    pinned_rules = F.col("rules_fingerprint").isNotNull()
    if rules_fingerprint is None:
        rules_bad, said = pinned_rules, F.lit("cannot verify the rules fingerprint")
    else:
        rules_bad = pinned_rules & (F.col("rules_fingerprint") != F.lit(rules_fingerprint))
        said = F.concat(F.lit("a rule definition changed since build (rules "), F.array_join("dr_set", ","), F.lit(")"))

    def found(test: Column, severity: str, check: str, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                                     F.col("output").alias("finding_id"), detail.alias("detail")))
    stale, source = "aggregate:freshness", F.concat(F.lit("source "), F.col("_source"))
    tests = F.array(
        found(first & ~there, sev, stale, F.lit("output is missing - rebuild")),
        found(first & there & ~F.col("_out").eqNullSafe(F.col("output_sha256")), sev, stale,
              F.lit("output changed since build")),
        found(there & F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("_pin")), sev, stale,
              F.concat(source, F.lit(" changed since build"))),
        found(there & F.col("_source").isNotNull() & F.col("_now").isNull(), M.WARN, "aggregate:unverifiable",
              F.concat(source, F.lit(" not present"))),
        found(first & there & rules_bad, sev, stale, said))
    return m.select("project", F.inline(F.array_compact(tests))).select(*VCOLS)


# -- G6 / G7 / G8 ----------------------------------------------------------------

def health(results: DataFrame) -> DataFrame:
    """Verified / drifted / cannot-verify / manual from the reason code."""
    mapping = F.create_map(*[x for k, v in M.HEALTH_OF_REASON.items() for x in (F.lit(k), F.lit(v))])
    return results.withColumn("health", F.coalesce(mapping[F.col("reason")], F.lit("drifted")))


# What to do about each reason a claim did not replay, and about each check.
FIX_BY_REASON = {
    M.R_VALUE: "Stored and computed value differ: register the claim again, or correct its measure.",
    M.R_ROW_COUNT: "Another number of rows passes the rules than was stored: compare the source's versions, then register again.",
    M.R_SOURCE_CHANGED: "The claim pins an older version of its source: restore that version or update the claim's input.",
    M.R_SOURCE_MISSING: "The claim's source is not registered or can't be opened: provide it, then replay.",
    M.R_RULE_UNKNOWN: "The claim names a rule without code: implement the rule or correct the claim's filters.",
    M.R_MEASURE_UNKNOWN: "The claim names a measure without code: implement it or correct the claim's code path.",
    M.R_NO_RESULT: "The data has no rows for the claim's key: correct the key or retire the claim.",
    "measure_error": "The measure fails on this source: see the error text of the replay.",
    "rule_error": "A rule of the chain doesn't fit this source: see the error text of the replay.",
    "group_key_unknown": "The source has no such key column: correct group_by.",
    "unclaimed_key": "The data holds a key that no claim covers: register a claim for it.",
}
FIX_BY_CHECK = {
    "aggregate:freshness": "An output no longer matches what it was built from: build it again.",
    "aggregate:unverifiable": "A pinned input can't be read here: provide it and check again.",
    "source_size": "Replay reads a large source: derive a smaller table with a manifest.",
    "decisions_caveats:pending": "The register leaves a question open: decide it.",
    "decisions_caveats": "Register and implemented rules differ: bring them to the same list.",
    "trust_memo": "Memo and ledger differ in the ids they use: correct the memo's citations.",
    "source_hash": "Pins of one source are absent or differ between claims: pin one version.",
    "schema_drift": "A source left its contract: adapt the source or lock a new contract.",
    "ledger": "A document can't be read as a finding: correct its JSON.",
}
DEFAULT_FIX = "See the detail of this check."


def action_items(results: DataFrame, violations: DataFrame) -> DataFrame:
    """Every drifted or unverifiable claim and every failure/warning,
    with a severity and a fix text; fix tables are code-sized literals."""
    h = health(results)
    reason_fix = F.create_map(*[x for k, v in FIX_BY_REASON.items() for x in (F.lit(k), F.lit(v))])
    claims = h.where(F.col("health").isin("drifted", "cannot-verify")).select(
        "project", F.concat(F.lit("replay:"), F.col("id")).alias("item"),
        F.when(F.col("health") == "drifted", F.lit(M.FAIL)).otherwise(F.lit(M.WARN)).alias("severity"),
        F.coalesce(reason_fix[F.col("reason")], F.lit(DEFAULT_FIX)).alias("fix"))
    fix = F.lit(DEFAULT_FIX)
    for prefix, text in sorted(FIX_BY_CHECK.items(), key=lambda kv: len(kv[0])):
        fix = F.when(F.col("check").startswith(prefix), F.lit(text)).otherwise(fix)
    checks = violations.where(F.col("severity").isin(M.FAIL, M.WARN) & ~F.col("check").startswith("replay:")).select(
        "project", F.concat_ws(":", "check", F.coalesce("finding_id", F.lit(""))).alias("item"), "severity",
        fix.alias("fix"))
    return claims.unionByName(checks)


def status_banner(results: DataFrame, violations: DataFrame) -> DataFrame:
    """Per project, counts of each health state, red and amber items, and
    whether everything is in sync."""
    h = health(results).groupBy("project").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.count_if(F.col("health") == "verified").alias("verified"),
        F.count_if(F.col("health") == "drifted").alias("drifted"),
        F.count_if(F.col("health") == "cannot-verify").alias("cannot_verify"),
        F.count_if(F.col("health") == "manual").alias("manual"))
    v = violations.where(~F.col("check").startswith("replay:")).groupBy("project").agg(
        F.count_if(F.col("severity") == M.FAIL).alias("red"), F.count_if(F.col("severity") == M.WARN).alias("amber"))
    j = h.join(v, "project", "left").fillna(0, ["red", "amber"])
    return j.withColumn("in_sync", (F.col("drifted") + F.col("cannot_verify") + F.col("red") + F.col("amber")) == 0)


# -- G9 / G10 / G11 / G14 --------------------------------------------------------

def trust_buckets(memo: DataFrame) -> DataFrame:
    """(project, id, bucket): the ``## heading`` a claim id is first cited
    under.  Documents are cut at their headings inside the row; the first
    citation is ``min_by`` over (document, heading) per id."""
    p = memo.select("project", "doc_id", F.inline(parts(F.col("text"), lambda x: x.rlike(r"^##\s+"))))
    cites = p.select("project", "doc_id", "pos", F.trim(F.regexp_extract("head", r"^##\s+(.*?)\s*$", 1)).alias("bucket"),
                     F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(M.ID_IN_TEXT), 0))).alias("id"))
    return cites.groupBy("project", "id").agg(F.min_by("bucket", F.struct("doc_id", "pos")).alias("bucket"))


def backlog_answers(claims: DataFrame) -> DataFrame:
    """G10, long form: (project, aid, id) for every claim addressing a
    question - no list per question, however many claims answer it."""
    return claims.select("project", "id", F.explode("addresses").alias("aid")).distinct()


def backlog_coverage(backlog: DataFrame, claims: DataFrame) -> DataFrame:
    """Question -> status -> how many claims address it and the first
    one (by id).  Aggregates only; the full mapping is ``backlog_answers``."""
    by_q = backlog_answers(claims).groupBy("project", "aid").agg(
        F.count(F.lit(1)).alias("n_claims"), F.min("id").alias("first_claim"))
    return backlog.join(by_q, ["project", "aid"], "left").select(
        "project", "aid", "status", "question", F.coalesce("n_claims", F.lit(0)).cast("int").alias("n_claims"),
        "first_claim")


def rule_citations(claims: DataFrame) -> DataFrame:
    """G11, long form: (project, rid, id) for every claim citing a rule among
    its decisions."""
    return claims.select("project", "id", F.explode("decisions").alias("rid")).distinct()


def rule_usage(rules: DataFrame, claims: DataFrame) -> DataFrame:
    """Rule -> status -> number of claims citing it and the first."""
    by_rule = rule_citations(claims).groupBy("project", "rid").agg(
        F.count(F.lit(1)).alias("n_claims"), F.min("id").alias("first_claim"))
    return rules.join(by_rule, ["project", "rid"], "left").select(
        "project", "rid", "status", F.coalesce("n_claims", F.lit(0)).cast("int").alias("n_claims"), "first_claim")


def caveat_register(docs: DataFrame) -> DataFrame:
    """(project, doc, heading, severity) for each ``###`` caveat
    section of the register documents (project, doc_id, text)."""
    from claimledger.operators.textops import field, sections
    s = sections(docs, r".+", level="###", carry=["project"])
    return s.select("project", "doc", F.trim(F.concat("id", "title")).alias("heading"),
                    F.coalesce(field(F.col("body"), "Severity"), F.lit("-")).alias("severity"))


# -- G12 / G13 / G15 -------------------------------------------------------------

@F.pandas_udf(T.StringType())
def _shown(kind: pd.Series, value: pd.Series) -> pd.Series:
    """Numbers as Python formats them (exact binary value, ties to even)."""
    return pd.Series([None if pd.isna(v) else f"{v:.1%}" if k == "proportion" else f"{v:,.4g}" for k, v in zip(kind, value)],
                     dtype=object)


def format_value(check_type: Column, value: Column, flag: Column | None = None, text: Column | None = None) -> Column:
    """Proportion as a percentage with one decimal, integral scalars and
    rates with thousands separators, other numbers to 4 significant digits;
    other values as they are."""
    plain = F.coalesce(text if text is not None else F.lit(None).cast("string"),
                       F.initcap(flag.cast("string")) if flag is not None else F.lit(None).cast("string"))
    return (F.when(check_type == "distribution", F.lit("distribution (see detail)"))
             .when(check_type == "matrix", F.lit("matrix (see detail)"))
             .when(value.isNull(), plain)
             .when(check_type.isin("scalar", "rate") & (value == F.rint(value)), F.format_number(value, 0))
             .when(check_type.isin("proportion", "scalar", "rate"), _shown(check_type, value))
             .otherwise(value.cast("string")))


def claim_detail(claims: DataFrame, results: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """One wide row per claim: value, replay state, tag, bucket,
    sources, filters, decisions, addresses, caveats."""
    h = health(results).select("project", "id", "status", "reason", "health")
    c = claims.select("project", "id", "claim", "check_type", "value_num", "value_bool", "value_str", "tag", "filters", "decisions",
                      "addresses", "caveats", F.transform("sources", lambda s: s["path"]).alias("sources"))
    j = c.join(h, ["project", "id"], "left")
    if buckets is not None:
        j = j.join(buckets, ["project", "id"], "left")
    else:
        j = j.withColumn("bucket", F.lit(None).cast("string"))
    return j.withColumn("shown_value", format_value(
        F.col("check_type"), F.col("value_num"), F.col("value_bool"), F.col("value_str"))).drop("value_bool", "value_str")


def publishable(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Only claims that replay green and are not tagged WEAK may be
    quoted: a semi join with the passing replay results."""
    ok = results.where(F.col("status") == "PASS").select("project", "id")
    return claims.where(F.coalesce(F.col("tag"), F.lit("")) != "WEAK").join(ok, ["project", "id"], "left_semi")
