"""Replay: values, rows, rules, types, tolerances, registration, updates."""

import math

import pytest
from conftest import finding, ledger_df

from claimledger.operators.registration import current_ledger, next_ids, register, register_computed, update
from claimledger.plans.replay import replay
from claimledger.sources.ledger_io import typed


def run(spark, registry, *fs, **kw):
    res = replay(typed(ledger_df(spark, *fs)), registry, **kw).collect()
    return {r["id"]: (r["status"], r["reason"]) for r in res}, res


def test_value_replays_green(spark, registry):
    out, _ = run(spark, registry, finding())
    assert out["F-001"] == ("PASS", "ok")


def test_wrong_value_and_row_count(spark, registry):
    out, _ = run(spark, registry, finding(value=99.9), finding(id="F-002",
                 reproducibility={"filters": [], "row_count_after_filter": 999}))
    assert out["F-001"] == ("FAIL", "value_mismatch")
    assert out["F-002"] == ("FAIL", "row_count")


def test_drop_rule_mean_and_rows(spark, registry):
    f = finding(code_path="a.py:mean_session_rating", value=4.166667,
                reproducibility={"filters": ["DR-001"], "row_count_after_filter": 9})
    out, res = run(spark, registry, f)
    assert out["F-001"] == ("PASS", "ok") and res[0]["rows"] == 9


def test_mask_rule_keeps_rows(spark, registry):
    f = finding(code_path="a.py:mean_session_rating", value=4.166667,
                reproducibility={"filters": ["DR_002"], "row_count_after_filter": 10})
    out, _ = run(spark, registry, f)
    assert out["F-001"] == ("PASS", "ok")


def test_boolean_both_ways(spark, registry):
    t = finding(check_type="boolean", code_path="a.py:any_zero_rating", value=True)
    f = finding(id="F-002", check_type="boolean", code_path="a.py:any_zero_rating", value=False)
    out, _ = run(spark, registry, t, f)
    assert out["F-001"][0] == "PASS" and out["F-002"][0] == "FAIL"


def test_distribution_both_ways(spark, registry):
    ok = finding(check_type="distribution", code_path="a.py:rating_summary", value=...,
                 distribution={"min": 0, "median": 4, "max": 5})
    bad = finding(id="F-002", check_type="distribution", code_path="a.py:rating_summary", value=...,
                  distribution={"min": 0, "median": 3, "max": 5})
    extra = finding(id="F-003", check_type="distribution", code_path="a.py:rating_summary", value=...,
                    distribution={"min": 0, "median": 4, "max": 5, "mean": 3.75})
    out, _ = run(spark, registry, ok, bad, extra)
    assert out == {"F-001": ("PASS", "ok"), "F-002": ("FAIL", "value_mismatch"), "F-003": ("FAIL", "value_mismatch")}


def test_matrix_both_ways(spark, registry, sessions):
    import numpy as np
    pdf = sessions.toPandas()
    m = np.corrcoef(pdf.session_rating, pdf.session_number).tolist()
    bad = [row[:] for row in m]
    bad[1][1] = 0.99
    out, _ = run(spark, registry,
                 finding(check_type="matrix", code_path="a.py:rating_matrix", value=..., matrix=m),
                 finding(id="F-002", check_type="matrix", code_path="a.py:rating_matrix", value=..., matrix=bad))
    assert out["F-001"][0] == "PASS" and out["F-002"][0] == "FAIL"


def test_proportion_l2_and_manual(spark, registry):
    out, _ = run(spark, registry,
                 finding(check_type="proportion", code_path="a.py:share_five", value=0.2),
                 finding(id="F-002", code_path="a.py:L2_norm", value=12.639225),
                 finding(id="F-003", check_type="manual", code_path="notes.md:L1-L2", value=...))
    assert out == {"F-001": ("PASS", "ok"), "F-002": ("PASS", "ok"), "F-003": ("AUDIT", "manual")}


def test_tolerance_edges(spark, registry):
    out, _ = run(spark, registry, finding(value=4.0000005), finding(id="F-002", value=4.001),
                 finding(id="F-003", value=4.005, tolerance={"abs": 0.01}),
                 finding(id="F-004", value=2.0, tolerance={"abs": 1.0}))
    assert [out[k][0] for k in ["F-001", "F-002", "F-003", "F-004"]] == ["PASS", "FAIL", "PASS", "FAIL"]


def test_unknown_rule_measure_and_sources(spark, registry):
    out, _ = run(spark, registry,
                 finding(reproducibility={"filters": ["DR-999"], "row_count_after_filter": 10}),
                 finding(id="F-002", code_path="a.py:nope"),
                 finding(id="F-003", input={"sources": [{"path": "missing"}], "columns": []}),
                 finding(id="F-004", code_path="a.py:L3-L4"))
    assert out["F-001"][1] == "rule_unknown" and out["F-002"][1] == "measure_unknown"
    assert out["F-003"][1] == "source_missing" and out["F-004"][1] == "measure_not_callable"


def test_fingerprint_pin(spark, registry):
    fp = spark.createDataFrame([("sessions", "abc")], "source string, sha256 string")
    out, _ = run(spark, registry, finding(input={"sources": [{"path": "sessions", "sha256": "abc"}], "columns": []}),
                 finding(id="F-002", input={"sources": [{"path": "sessions", "sha256": "zzz"}], "columns": []}),
                 fingerprints=fp)
    assert out["F-001"][0] == "PASS" and out["F-002"] == ("FAIL", "source_changed")


def test_quote_claims(spark, registry):
    corpus = spark.createDataFrame([("notes.md", "the median rating was four")], "locator string, text string")
    q = dict(check_type="quote_provenance", code_path="notes.md:L1", value=...)
    out, _ = run(spark, registry, finding(quote="median rating", source_locator="notes.md:L1-L2", **q),
                 finding(id="F-002", quote="mean rating", source_locator="notes.md", **q),
                 finding(id="F-003", quote="median", source_locator="../outside.md", **q), corpus=corpus)
    assert out["F-001"] == ("PASS", "ok")
    assert out["F-002"] == ("FAIL", "quote_not_found")
    assert out["F-003"] == ("FAIL", "locator_outside_corpus")


def test_register_computed_ignores_supplied_value(spark, registry):
    empty = spark.createDataFrame([], "project string, doc string")
    acc, rej = register_computed(empty, ledger_df(spark, finding(value=999.0)), registry, "initial", "t0")
    t = typed(acc).collect()[0]
    assert t["value_num"] == 4.0 and t["row_count"] == 10 and rej.count() == 0


def test_register_rejects_nan_duplicates_and_existing(spark):
    existing = ledger_df(spark, finding(id="F-001"))
    incoming = ledger_df(spark, finding(id="F-001"), finding(id="F-002"), finding(id="F-003"), finding(id="F-003"),
                         '{"id": "F-004", "value": NaN}')
    acc, rej = register(existing, incoming, "batch", "t0")
    assert sorted(r["id"] for r in acc.collect()) == ["F-002", "F-003"]  # of F-003 the first copy
    reasons = {(r["id"], r["reason"]) for r in rej.collect()}
    assert ("F-001", "ids:exists") in reasons and ("F-003", "ids:duplicate_in_batch") in reasons
    assert any(r == "ledger:parses" for _, r in reasons)


def test_next_id_and_update(spark):
    led = ledger_df(spark, finding(id="F-001"), finding(id="F-002b"))
    inc = spark.createDataFrame([("p", 1)], "project string, k int")
    assert next_ids(led, inc, "k").collect()[0]["new_id"] == "F-003"
    acc, _ = register(spark.createDataFrame([], "project string, doc string"), led, "initial", "t0")
    ch = spark.createDataFrame([("p", "F-001", '{"claim": "changed"}'), ("p", "F-404", '{"claim": "x"}')],
                               "project string, id string, doc string")
    new, unknown = update(acc, ch, "revise", "t1")
    cur = typed(current_ledger(acc.unionByName(new)).select("project", "doc")).where("id = 'F-001'").collect()[0]
    assert cur["claim"] == "changed" and len(cur["revision_history"]) == 2
    assert [r["id"] for r in unknown.collect()] == ["F-404"]


@pytest.mark.parametrize("e,a", [(4.0, 4.0000005), (4.0, 4.001), (float("nan"), float("nan")),
                                 (float("inf"), float("inf")), (float("inf"), 1.0), (0.0, 1e-7), (-1e9, -1e9 - 1)])
def test_is_close_matches_python(spark, e, a):
    from pyspark.sql import functions as F

    from claimledger.functions.compare import is_close
    got = spark.range(1).select(is_close(F.lit(e), F.lit(a)).alias("c")).collect()[0]["c"]
    assert got == math.isclose(e, a, rel_tol=1e-9, abs_tol=1e-6)


def test_bad_groups_fail_alone(spark, registry):
    from pyspark.sql import functions as F

    from claimledger.operators import measures as ms
    from claimledger.operators import rules as rl

    def gone(s):
        return s.read.parquet("/nowhere/at/all.parquet")
    registry.register_source("gone", gone)
    registry.register_rule(rl.drop_equal("DR-050", "no_such_column", 1))
    registry.register_rule(rl.keep_where("DR-051", lambda c: c("session_id").cast("int") > 0))
    registry.register_measure(ms.mean("raises", F.col("coach_id").cast("int")))
    registry.register_measure(ms.mean("unfit", "no_such_column"))
    other = {"sources": [{"path": "gone"}], "columns": []}
    filters = lambda r: {"filters": [r], "row_count_after_filter": 10}
    out, res = run(spark, registry, finding(), finding(id="F-002", input=other),
                   finding(id="F-003", reproducibility=filters("DR-050")), finding(id="F-004", group_by="nope", group_key="1"),
                   finding(id="F-005", code_path="a.py:raises"), finding(id="F-006", code_path="a.py:unfit"),
                   finding(id="F-007", reproducibility=filters("DR-051")),
                   finding(id="F-008", check_type="boolean", code_path="a.py:any_zero_rating", value=True))
    assert out == {"F-001": ("PASS", "ok"), "F-002": ("FAIL", "source_missing"), "F-003": ("FAIL", "rule_error"),
                   "F-004": ("FAIL", "group_key_unknown"), "F-005": ("FAIL", "measure_error"),
                   "F-006": ("FAIL", "measure_error"), "F-007": ("FAIL", "measure_error"), "F-008": ("PASS", "ok")}
    assert all(r["error"] for r in res if r["reason"] in ("source_missing", "rule_error", "measure_error"))


def test_no_rows_left_is_a_result(spark, registry):
    from claimledger.operators import measures as ms
    from claimledger.operators import rules as rl
    registry.register_rule(rl.keep_where("DR-060", lambda c: c("session_rating") > 100))
    registry.register_measure(ms.count_rows("n_rows"))
    registry.register_measure(ms.total("sum_rating", "session_rating"))
    none = {"filters": ["DR-060"], "row_count_after_filter": 0}
    out, _ = run(spark, registry, finding(code_path="a.py:n_rows", value=0, reproducibility=none),
                 finding(id="F-002", check_type="boolean", code_path="a.py:any_zero_rating", value=False, reproducibility=none),
                 finding(id="F-003", code_path="a.py:n_rows", value=1, reproducibility=none),
                 finding(id="F-004", code_path="a.py:mean_session_rating", value=4.0, reproducibility=none),
                 finding(id="F-005", code_path="a.py:sum_rating", value=0, reproducibility=none),
                 finding(id="F-006", code_path="a.py:n_rows", value=0,
                         reproducibility={"filters": ["DR-060"], "row_count_after_filter": 3}))
    assert {k: v[1] for k, v in out.items()} == {"F-001": "ok", "F-002": "ok", "F-003": "value_mismatch",
                                                 "F-004": "value_mismatch", "F-005": "ok", "F-006": "row_count"}
    acc, rej = register_computed(spark.createDataFrame([], "project string, doc string"), ledger_df(
        spark, finding(code_path="a.py:n_rows", value=5, reproducibility=none)), registry, "r", "t")
    assert rej.count() == 0 and typed(acc).collect()[0]["value_num"] == 0


def test_keyed_claims_are_matched_both_ways(spark, registry):
    from claimledger.operators import measures as ms
    from claimledger.plans.replay import replay_keyed
    registry.register_measure(ms.count_rows("n_rows"))
    keyed = lambda i, k, v, n: finding(id=i, code_path="a.py:n_rows", value=v, group_by="coach_id", group_key=k,
                                       reproducibility={"filters": [], "row_count_after_filter": n})
    led = ledger_df(spark, keyed("F-001", "C1", 3, 3), keyed("F-002", "C9", 1, 1))
    got = {(r["id"], r["status"], r["reason"]) for r in replay_keyed(typed(led), registry).collect()}
    assert got == {("F-001", "PASS", "ok"), ("F-002", "FAIL", "no_result"),
                   ("n_rows[C2]", "FAIL", "unclaimed_key"), ("n_rows[C3]", "FAIL", "unclaimed_key")}
