"""Cross-reference and status operators on small hand-made registers."""

from pyspark.sql import functions as F

from claimledger.operators.checks import user_checks
from claimledger.operators.status import (backlog_answers, backlog_coverage, caveat_register, lineage,
                                          orphan_citations, rule_caveat_sync, rule_usage)
from claimledger.sources.manifest import load_manifests


def test_backlog_and_rule_usage_are_counts(spark):
    claims = spark.createDataFrame([("p", "F-001", ["A-1"], ["DR-001"]), ("p", "F-002", ["A-1"], []),
                                    ("p", "F-003", ["A-2"], ["DR-001", "DR-002"])],
                                   "project string, id string, addresses array<string>, decisions array<string>")
    bl = spark.createDataFrame([("p", "A-1", "open", "q1"), ("p", "A-2", "open", "q2"), ("p", "A-3", "open", "q3")],
                               "project string, aid string, status string, question string")
    cov = {r["aid"]: (r["n_claims"], r["first_claim"]) for r in backlog_coverage(bl, claims).collect()}
    assert cov == {"A-1": (2, "F-001"), "A-2": (1, "F-003"), "A-3": (0, None)}
    assert backlog_answers(claims).count() == 3
    rules = spark.createDataFrame([("p", "DR-001", "active"), ("p", "DR-003", "active")],
                                  "project string, rid string, status string")
    use = {r["rid"]: r["n_claims"] for r in rule_usage(rules, claims).collect()}
    assert use == {"DR-001": 2, "DR-003": 0}


def test_orphans_and_abandonment(spark):
    ledger = spark.createDataFrame([("p", f"F-{i:03d}") for i in range(1, 30)] + [("q", "F-001")],
                                   "project string, id string")
    memo = spark.createDataFrame([("p", 1, "## Reliable\nF-001\n"), ("q", 1, "F-999 is cited")],
                                 "project string, doc_id int, text string")
    v = {(r["project"], r["check"], r["finding_id"]) for r in orphan_citations(ledger, memo).collect()}
    assert ("q", "trust_memo:orphans", "F-999") in v
    assert ("p", "trust_memo:abandonment", None) in v


def test_rule_caveat_sync_both_ways_and_dormant(spark):
    cav = spark.createDataFrame([("p", 1, "### a\nDR-001 and DR-002\nPending decision\n"),
                                 ("q", 1, "{{MUST_CUSTOMIZE}} DR-009")], "project string, doc_id int, text string")
    impl = spark.createDataFrame([("p", "DR-001"), ("p", "DR-003"), ("q", "DR-001")], "project string, id string")
    st = spark.createDataFrame([("p", "DR-001", "dropped"), ("p", "DR-003", "active")],
                               "project string, id string, status string")
    v = rule_caveat_sync(cav, impl, st, fast=False).collect()
    assert {r["project"] for r in v} == {"p"}  # q is dormant
    details = sorted(r["detail"] for r in v)
    assert any("DR-002 but it has no implementation" in d for d in details)
    assert any("DR-001 but it is dropped" in d for d in details)
    assert any(d.startswith("DR-003 is active") for d in details)
    assert {r["severity"] for r in rule_caveat_sync(cav, impl, st, fast=True).where("check != 'decisions_caveats:pending'").collect()} == {"WARN"}


def test_caveat_register_and_lineage(spark):
    docs = spark.createDataFrame([("p", 1, "### Zero ratings\n**Severity:** high\ntext\n### Late data\nno field\n")],
                                 "project string, doc_id int, text string")
    got = {(r["heading"], r["severity"]) for r in caveat_register(docs).collect()}
    assert got == {("Zero ratings", "high"), ("Late data", "-")}
    claims = spark.createDataFrame([("p", "F-001", [("daily.csv", None)])],
                                   "project string, id string, sources array<struct<path:string,sha256:string>>")
    man = spark.createDataFrame([("daily.csv", {"raw.csv": "h"}, ["DR-001"], "t0")],
                                "output string, sources map<string,string>, dr_set array<string>, built_at string")
    r = lineage(claims, man).collect()[0]
    assert (r["raw_source"], r["dr_set"], r["built_at"]) == ("raw.csv", "DR-001", "t0")


def test_load_manifests_reports_bad_documents(spark):
    raw = spark.createDataFrame([("a", '{"output": "x.csv", "output_sha256": "h"}'), ("b", '{"output_sha'),
                                 ("c", '{"built_at": "t"}')], "manifest_id string, doc string")
    ok, bad = load_manifests(raw)
    assert [r["output"] for r in ok.collect()] == ["x.csv"]
    assert {(r["manifest_id"], r["detail"]) for r in bad.collect()} == {
        ("b", "manifest does not parse"), ("c", "manifest has no output field")}


def test_user_checks_union(spark):
    led = spark.createDataFrame([("p", '{"id": "F-001"}')], "project string, doc string")

    def always(ledger):
        return ledger.select("project", F.lit("project:x").alias("check"), F.lit("WARN").alias("severity"),
                             F.lit(None).cast("string").alias("finding_id"), F.lit("d").alias("detail"))
    assert user_checks(led, {"x": always}).count() == 1
    assert user_checks(led, {}).count() == 0
