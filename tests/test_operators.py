"""Profile, rules, measures, ordered operators, fingerprints, contracts,
text, freshness and the streaming gate."""

import os
import tempfile

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimledger.operators import profile as pf
from claimledger.operators import rules as rl
from claimledger.operators.contract import quarantine, schema_drift
from claimledger.operators.ordered import cumulative_counts, exact_quantiles
from claimledger.operators.status import freshness, trust_buckets
from claimledger.operators.textops import field, rule_statuses, sections
from claimledger.sources.fingerprint import content_fingerprint


def test_profile_counts(sessions):
    d = {r["column"]: r["nulls"] for r in pf.describe(sessions, "s").collect()}
    assert d == {"session_id": 0, "session_rating": 0, "coach_id": 0, "session_number": 0}
    row = pf.sample_and_count(sessions, 3).collect()[0]
    assert (row["total_rows"], row["sample_rows"], row["sampled"]) == (10, 3, True)
    assert pf.all_zero_rows(sessions, ["session_rating"]).collect()[0]["all_zero"] == 1
    top = pf.domain_counts(sessions, "coach_id", k=1).collect()[0]
    assert (top["value"], top["n"]) == ("C3", 4)


def test_rules_are_idempotent_and_attrition_is_one_pass(sessions, registry):
    once = rl.apply_rules(sessions, ["DR-001"], registry)
    twice = rl.apply_rules(once, ["DR-001"], registry)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    att = [r["rows"] for r in rl.attrition(sessions, ["DR-002", "DR-001"], registry).orderBy("step").collect()]
    assert att == [10, 10, 10]   # masking first turns the sentinel into missing, which DR-001 keeps
    att = [r["rows"] for r in rl.attrition(sessions, ["DR-001", "DR-002"], registry).orderBy("step").collect()]
    assert att == [10, 9, 9]


def test_unknown_rule_is_an_error_before_any_job(sessions, registry):
    import pytest
    with pytest.raises(KeyError):
        rl.apply_rules(sessions, ["DR-404"], registry)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=40),
       st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_exact_quantile_equals_numpy(spark, values, p):
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(values)], "k int, v double")
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", [p]).collect()}
    for k in got:
        xs = [float(v) for i, v in enumerate(values) if i % 3 == k]
        assert abs(got[k] - float(np.percentile(xs, p * 100))) < 1e-9


def test_cumulative_counts(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [3, 1, 2, 2, 5]], "k int, v double")
    got = sorted((r["v"], r["before"], r["n"]) for r in cumulative_counts(df, ["k"], "v", 3).collect())
    assert got == [(1.0, 0, 5), (2.0, 1, 5), (3.0, 3, 5), (5.0, 4, 5)]


def test_content_fingerprint_is_layout_free(sessions):
    a = content_fingerprint(sessions).collect()[0]["fingerprint"]
    b = content_fingerprint(sessions.repartition(3).orderBy(F.desc("session_id"))).collect()[0]["fingerprint"]
    c = content_fingerprint(sessions.where("session_id <> 'S001'")).collect()[0]["fingerprint"]
    assert a == b and a != c


def test_contract_drift_and_quarantine(spark, sessions):
    from claimledger.operators.contract import ColumnSpec, SchemaContract
    con = SchemaContract((ColumnSpec("session_id", "string", False, True),
                          ColumnSpec("session_rating", "double", True, False, 0.0, 5.0)))
    assert schema_drift(sessions, con, "sessions").count() == 0
    drifted = sessions.withColumn("session_rating", F.when(F.col("session_id") == "S001", 9.0)
                                  .otherwise(F.col("session_rating")))
    rows = schema_drift(drifted, con, "sessions").collect()
    assert [(r["check"], r["column"], r["failures"]) for r in rows] == [("le", "session_rating", 1)]
    good, bad = quarantine(drifted, con)
    assert good.columns == ["session_id", "session_rating"] and bad.count() == 1


def test_sections_fields_and_statuses(spark):
    text = ("### DR-001 — drop zero ratings\n**Status:** Active\n**Rule:** rating == 0\n"
            "### DR-002: mask\n**Rule:** mask\n### DR-001 — again\n**Status:** superseded\n")
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    s = sections(docs, r"DR-\d+").orderBy("pos").collect()
    assert [(r["id"], r["title"]) for r in s] == [("DR-001", "drop zero ratings"), ("DR-002", "mask"),
                                                  ("DR-001", "again")]
    st_ = sections(docs, r"DR-\d+").select("id", field(F.col("body"), "Status").alias("s")).collect()
    assert {(r["id"], r["s"]) for r in st_} == {("DR-001", "Active"), ("DR-002", None), ("DR-001", "superseded")}
    assert {r["id"]: r["status"] for r in rule_statuses(docs).collect()} == {"DR-001": "superseded",
                                                                            "DR-002": "unknown"}


def test_trust_buckets_first_heading_wins(spark):
    memo = spark.createDataFrame([("p", 1, "## Reliable\nF-001 and F-002\n## Noisy\nF-002, F-003\n")],
                                 "project string, doc_id int, text string")
    got = {r["id"]: r["bucket"] for r in trust_buckets(memo).collect()}
    assert got == {"F-001": "Reliable", "F-002": "Reliable", "F-003": "Noisy"}


def test_freshness_cases(spark):
    man = spark.createDataFrame([
        ("p", "agg.csv", "h_out", {"big.csv": "h_src"}, ["DR-001"], "rules1"),
        ("p", "gone.csv", "h", {}, [], None),
        ("p", "agg2.csv", "h_old", {"big.csv": "h_old_src", "absent.csv": "x"}, ["DR-001"], "rules0")],
        "project string, output string, output_sha256 string, sources map<string,string>, dr_set array<string>, "
        "rules_fingerprint string")
    cur = spark.createDataFrame([("agg.csv", "h_out"), ("big.csv", "h_src"), ("agg2.csv", "h_new")],
                                "path string, sha256 string")
    v = freshness(man, cur, "rules1", fast=False).collect()
    by_out = {}
    for r in v:
        by_out.setdefault(r["finding_id"], set()).add((r["check"], r["severity"]))
    assert "agg.csv" not in by_out
    assert by_out["gone.csv"] == {("aggregate:freshness", "FAIL")}
    assert by_out["agg2.csv"] == {("aggregate:freshness", "FAIL"), ("aggregate:unverifiable", "WARN")}
    assert len([r for r in v if r["finding_id"] == "agg2.csv"]) == 4
    assert {r["severity"] for r in freshness(man, cur, "rules1", fast=True).collect()} == {"WARN"}


def test_streaming_gate(spark):
    import json

    from claimledger.streaming.gate import start_gate
    from conftest import finding
    root = tempfile.mkdtemp(prefix="gate-")
    inbox = os.path.join(root, "inbox")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "a.json"), "w") as fh:
        fh.write(json.dumps(finding(id="F-001")) + "\n" + json.dumps(finding(id="F-002", value=...)) + "\n")
    q = start_gate(spark, inbox, os.path.join(root, "acc"), os.path.join(root, "rej"), os.path.join(root, "ck"), "t0")
    q.awaitTermination(120)
    with open(os.path.join(inbox, "b.json"), "w") as fh:
        fh.write(json.dumps(finding(id="F-001")) + "\n" + json.dumps(finding(id="F-003")) + "\n")
    q = start_gate(spark, inbox, os.path.join(root, "acc"), os.path.join(root, "rej"), os.path.join(root, "ck"), "t0")
    q.awaitTermination(120)
    acc = sorted(r["id"] for r in spark.read.parquet(os.path.join(root, "acc")).collect())
    rej = {(r["id"], r["reason"]) for r in spark.read.parquet(os.path.join(root, "rej")).collect()}
    assert acc == ["F-001", "F-003"]
    assert ("F-001", "ids:exists") in rej and ("F-002", "conditional:value") in rej


def test_rate_counts_rows_of_missing_units(spark):
    from claimledger.operators import measures as ms
    from claimledger.plans.evaluate import evaluate
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "u string")
    _, vals = evaluate(df, [ms.rate("r", "u")])
    assert [r["num"] for r in vals.collect()] == [2.0]


def test_spearman_against_ranks(spark):
    from claimledger.operators import measures as ms
    from claimledger.plans.evaluate import evaluate
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (2.0, None)], "x double, y double")
    _, vals = evaluate(df, [ms.spearman_matrix("s", ["y", "x"]), ms.spearman("one", "x", "y")])
    want = np.corrcoef(rank(x), rank(y))[0, 1]
    got = {(r["measure"], r["part"]): r["num"] for r in vals.collect()}
    assert abs(got["s", "0,0"] - 1) < 1e-12 and abs(got["one", "value"] - want) < 1e-12
    assert abs(got["s", "0,1"] - want) < 1e-12 and abs(got["s", "1,0"] - want) < 1e-12


def test_row_all_reads_the_columns_as_the_chain_left_them(spark):
    from claimledger.operators import measures as ms
    from claimledger.plans.evaluate import evaluate_groups
    from claimledger.registry import Registry
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (2.0, 2.0)], "x double, y double")
    reg = Registry().register_rule(rl.mask_equal("DR-001", "x", 0.0)).register_rule(
        rl.keep_all("DR-002", ["x", "y"], lambda c: c >= 0)).register_rule(rl.keep_any("DR-003", ["x"], lambda c: c >= 0))
    for ids in (["DR-001", "DR-002"], ["DR-001", "DR-003"]):
        assert rl.apply_rules(df, ids, reg).count() == 2
        assert [r["rows"] for r in rl.attrition(df, ids, reg).orderBy("step").collect()] == [3, 3, 2]
        rows, _ = evaluate_groups(df, [([reg.rules[i] for i in ids], None)], [ms.count_rows("n")])
        assert [r["rows"] for r in rows.collect()] == [2]


def test_rules_fingerprint_sees_closures():
    from claimledger.registry import Registry, Rule

    def factory(limit):
        return Rule("DR-001", fn=lambda df: df.where(F.col("x") > limit))
    one, two, same = (Registry().register_rule(factory(k)).rules_fingerprint() for k in (1, 2, 1))
    assert one != two and one == same
