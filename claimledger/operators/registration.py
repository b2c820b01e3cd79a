"""Registration: ledger DML as batch DataFrame operations.

The ledger is append-only: every registration or update appends a revision
row (project, id, rev, doc); the current ledger is the latest revision per
id (E4).  Validation reuses the ledger checks, so a finding is rejected at
write time for exactly the defects the validator would report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger import model as M
from claimledger.operators.checks import extracted, structural_checks
from claimledger.plans.replay import compute_groups, distinct_groups, precheck
from claimledger.registry import Registry
from claimledger.session import materialize
from claimledger.sources.ledger_io import get, is_number, is_object, merge_documents, parse, to_document, typed

# Checks that registration does not enforce: history and caveats are
# stamped by registration itself; measure resolution happens at replay.
_NOT_AT_WRITE = ["revision_history:nonempty", "caveats:empty", "code_path:resolves", "code_path:escapes"]

REVISION_SCHEMA = "project string, id string, rev int, doc string"


def _reject_reasons(incoming: DataFrame) -> DataFrame:
    """(project, id, reason) for every write-time defect."""
    x = extracted(incoming)  # the documents are parsed once; all reasons come from the stored columns
    not_json = x.where(~F.col("is_finding")).select(
        "project", F.lit(None).cast("string").alias("id"), F.lit("ledger:parses").alias("reason"))
    chk = structural_checks(x).where(
        (F.col("severity") == M.FAIL) & ~F.col("check").isin(_NOT_AT_WRITE)
        & ~((F.col("check") == "schema:required") & F.col("detail").isin("revision_history", "caveats")))
    chk = chk.select("project", F.col("finding_id").alias("id"), F.col("check").alias("reason"))
    nonfinite = x.where(is_number(F.col("t_value")) & (F.isnan("d_value") | (F.abs("d_value") == float("inf")))).select(
        "project", F.col("s_id").alias("id"), F.lit("value:finite").alias("reason"))
    return not_json.unionByName(chk).unionByName(nonfinite)


def _ids(ledger: DataFrame) -> DataFrame:
    """(project, id, doc); the id is NULL where the document is no object or has none."""
    v = F.when(is_object(F.expr("schema_of_variant(v)")), F.col("v"))
    return parse(ledger).withColumn("v", v).select("project", get("$.id", "string").alias("id"), "doc")


def stamp_fingerprints(t: DataFrame, fingerprints: DataFrame | None) -> DataFrame:
    """Fill only the missing fingerprints of sources that are present.

    Sources are exploded with their position, joined to the fingerprint
    table on path (a join: the fingerprint table may be large, e.g. one row
    per partition) and regrouped per finding (bounded by its own sources).
    Findings are keyed by (project, id), unique at both call sites."""
    if fingerprints is None:
        return t
    fp = fingerprints.select(F.col("source").alias("_p"), F.col("sha256").alias("_h"))
    ex = t.select(F.col("project").alias("_pj"), F.col("id").alias("_id"),
                  F.posexplode("sources").alias("_pos", "_s"))
    ex = ex.join(fp, ex["_s"]["path"] == fp["_p"], "left")
    re = ex.groupBy("_pj", "_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "_pos", F.struct(F.col("_s")["path"].alias("path"),
                         F.coalesce(F.col("_s")["sha256"], F.col("_h")).alias("sha256")).alias("_v")))),
        lambda x: x["_v"]).alias("_sources"))
    out = t.join(re, (t["project"] == re["_pj"]) & (t["id"] == re["_id"]), "left")
    return out.withColumn("sources", F.when(F.col("_sources").isNotNull(), F.col("_sources"))
                          .otherwise(F.col("sources"))).drop("_pj", "_id", "_sources")


def register(ledger: DataFrame, incoming: DataFrame, reason: str, now: str | Column,
             fingerprints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted revisions, rejected).

    ``ledger`` and ``incoming`` are (project, doc).  A finding is rejected when
    its id already exists in the project or fails write-time validation; of
    findings that share an id in the batch the first (by text: rows have no
    order) is taken.  Accepted findings get default caveats, a first revision,
    and stamped fingerprints; all their other fields are kept.
    """
    now_c = now if isinstance(now, Column) else F.lit(now)
    known = _ids(ledger).select("project", "id").distinct()
    # stored once, with the id: every branch below reads the text again, and a filter on an id that
    # is still to be parsed would be pushed below the parse
    batch = materialize(_ids(incoming))
    t = batch.where(F.col("id").isNotNull())
    copies = t.groupBy("project", "id").agg(F.count(F.lit(1)).alias("count"), F.min("doc").alias("first"))
    dup_batch = copies.where("count > 1").select("project", "id", F.lit("ids:duplicate_in_batch").alias("reason"))
    exists = copies.select("project", "id").join(known, ["project", "id"], "left_semi").select(
        "project", "id", F.lit("ids:exists").alias("reason"))
    # read twice: for the keys that are left out, and as the answer
    rejected = materialize(_reject_reasons(batch.select("project", "doc")).unionByName(exists).distinct())
    bad_keys = rejected.select("project", "id").where(F.col("id").isNotNull()).distinct()
    rejected = rejected.unionByName(dup_batch)
    ok = copies.select("project", "id", F.col("first").alias("doc")).join(bad_keys, ["project", "id"], "left_anti")
    ok = typed(ok.where(F.col("project").isNotNull()).select("project", "doc"))
    ok = (ok.withColumn("caveats", F.coalesce("caveats", F.array().cast("array<string>")))
            .withColumn("revision_history", F.array(F.struct(now_c.alias("timestamp"),
                                                             F.lit(reason).alias("reason")))))
    ok = stamp_fingerprints(ok, fingerprints)
    accepted = to_document(ok).select("project", "id", F.lit(1).alias("rev"), "doc")
    return accepted, rejected.select("project", "id", "reason").distinct()


def register_computed(ledger: DataFrame, specs: DataFrame, registry: Registry, reason: str,
                      now: str | Column, fingerprints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Run rules + measure on the declared source and store the result.

    Any supplied value is ignored; ``row_count_after_filter`` becomes the
    actual count.  Uses the same grouped evaluation as replay, so "computed"
    is exactly what replay will re-run.  Only replayable types are accepted.
    """
    spark = specs.sparkSession
    t = typed(specs)
    c = precheck(t, registry, None)
    wrong = c.where(~F.coalesce(F.col("check_type").isin(M.REPLAYABLE_TYPES), F.lit(False))
                    | F.col("pre_reason").isNotNull()).select(
        "project", "id", F.coalesce(F.col("pre_reason"), F.lit("register_computed:type")).alias("reason"))
    good = materialize(c.where(F.col("check_type").isin(M.REPLAYABLE_TYPES) & F.col("pre_reason").isNull()))
    results, rows, broken = compute_groups(spark, distinct_groups(good), registry)
    k = ["source", "fkey", "group_by", "group_key"]
    j = (good.alias("c")
         .join(rows.alias("r"), [F.col(f"c.{x}").eqNullSafe(F.col(f"r.{x}")) for x in k], "left")
         .join(results.alias("m"), [F.col(f"c.{x}").eqNullSafe(F.col(f"m.{x}")) for x in k + ["measure"]], "left")
         .select("c.*", F.col("r.rows").alias("_rows"), F.col("m.num").alias("_num"), F.col("m.flag").alias("_flag"),
                 F.col("m.dist").alias("_dist"), F.col("m.matrix").alias("_matrix")))
    ct = F.col("check_type")
    filled = (j.withColumn("value_v", F.lit(None).cast("variant"))
               .withColumn("value_num", F.when(ct.isin(M.SCALAR_TYPES), F.col("_num")))
               .withColumn("value_bool", F.when(ct == "boolean", F.col("_flag")))
               .withColumn("value_str", F.lit(None).cast("string"))
               .withColumn("distribution", F.when(ct == "distribution", F.col("_dist")))
               .withColumn("matrix", F.when(ct == "matrix", F.col("_matrix")))
               .withColumn("row_count", F.col("_rows")))
    docs = materialize(to_document(filled).select("project", "doc"))
    accepted, rejected = register(ledger, docs, reason, now, fingerprints)
    return accepted, rejected.unionByName(wrong)


def update(revisions: DataFrame, changes: DataFrame, reason: str, now: str | Column,
           fingerprints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge changed fields into the current finding, append a revision.

    ``changes`` is (project, id, doc) where doc holds only the changed fields;
    any field but id and revision_history can change.  Returns (new revision
    rows, rejected): unknown ids, several changes of one id, and changes whose
    result fails write-time validation.  When ``input`` changes, stale
    fingerprints are dropped and re-pinned.
    """
    now_c = now if isinstance(now, Column) else F.lit(now)
    cur = current_ledger(revisions)
    several = changes.groupBy("project", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("project", "id")
    unknown = changes.join(cur, ["project", "id"], "left_anti").select(
        "project", "id", F.lit("update:unknown_id").alias("reason"))
    one = parse(changes.join(several, ["project", "id"], "left_anti"))
    is_doc = F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False))
    broken = one.where(~is_doc).select("project", "id", F.lit("ledger:parses").alias("reason"))
    one = one.where(is_doc).select("project", "id", F.col("doc").alias("_change"))
    merged = cur.join(one, ["project", "id"]).select(
        "project", F.col("id").alias("_id"), (F.col("rev") + 1).alias("_rev"),
        F.expr("variant_get(try_parse_json(_change), '$.input', 'variant') IS NOT NULL").alias("_repin"),
        merge_documents(F.col("doc"), F.col("_change"), ["id", "revision_history"]).alias("doc"))
    t = typed(merged, carry=["_id", "_rev", "_repin"])
    t = t.withColumn("id", F.col("_id")).withColumn("sources", F.when(F.col("_repin"), F.transform(
        "sources", lambda s: F.struct(s["path"].alias("path"), F.lit(None).cast("string").alias("sha256"))))
        .otherwise(F.col("sources")))
    t = t.withColumn("revision_history", F.concat(
        F.coalesce("revision_history", F.array().cast("array<struct<timestamp:string,reason:string>>")),
        F.array(F.struct(now_c.alias("timestamp"), F.lit(reason).alias("reason")))))
    t = stamp_fingerprints(t, fingerprints)
    new = materialize(to_document(t).join(t.select("project", "id", F.col("_rev").alias("rev")), ["project", "id"])
                      .select("project", "id", "rev", "doc"))
    invalid = _reject_reasons(new.select("project", "doc")).distinct()
    rejected = reduce(DataFrame.unionByName, [
        unknown, broken, invalid, several.withColumn("reason", F.lit("update:duplicate_in_batch"))])
    accepted = new.join(invalid.select("project", "id").distinct(), ["project", "id"], "left_anti")
    return accepted.select("project", "id", "rev", "doc"), rejected.distinct()


def current_ledger(revisions: DataFrame) -> DataFrame:
    """Latest revision per (project, id) as (project, id, rev, doc).

    ``max_by`` is an aggregate (combines map-side), so a finding with many
    revisions never needs its history in one place.
    """
    return revisions.groupBy("project", "id").agg(
        F.max("rev").alias("rev"), F.max_by("doc", "rev").alias("doc"))


def next_ids(ledger: DataFrame, incoming: DataFrame, order_col: str) -> DataFrame:
    """E5: assign ids to a batch: per project, max numeric part + 1 onward,
    alpha suffixes ignored, zero-padded to three digits.

    Incoming rows are numbered by ``order_col`` (unique within a project)
    with the distributed running count of :func:`cumulative_counts`, so a
    project with a huge batch is never numbered inside one task.
    """
    from claimledger.operators.ordered import cumulative_counts
    t = typed(ledger)
    top = (t.where(F.col("id").rlike(r"^F-\d"))
            .groupBy("project").agg(F.max(F.regexp_extract("id", r"^F-(\d+)", 1).cast("long")).alias("_top")))
    pos = cumulative_counts(incoming.select("project", order_col), ["project"], order_col)
    j = (incoming.join(pos.select("project", order_col, "before"), ["project", order_col])
                 .join(top, "project", "left"))
    nid = F.coalesce(F.col("_top"), F.lit(0)) + F.col("before") + 1
    return j.withColumn("new_id", F.format_string("F-%03d", nid)).drop("before", "_top")
