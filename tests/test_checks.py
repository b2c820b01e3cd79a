"""Ledger checks: every check both ways (green passes, seeded defect fails)."""

from conftest import finding, ledger_df

from claimledger.operators.checks import group_checks, structural_checks, verdict
from claimledger.sources.ledger_io import document_violations, split_json_arrays

NAMES = ["median_session_rating", "mean_session_rating", "L2_norm", "share_five"]


def fails(spark, *fs, names=NAMES):
    led = ledger_df(spark, *fs)
    v = structural_checks(led, names).unionByName(group_checks(led)).collect()
    return {(r["check"], r["severity"]) for r in v}, v


def fail_checks(spark, *fs):
    got, _ = fails(spark, *fs)
    return {c for c, s in got if s == "FAIL"}


def test_minimal_valid_finding_has_no_failure(spark):
    assert fail_checks(spark, finding()) == set()


def test_only_id_fails_required_fields(spark):
    _, rows = fails(spark, {"id": "F-001"})
    missing = {r["detail"] for r in rows if r["check"] == "schema:required"}
    assert missing == {"claim", "check_type", "code_path", "input", "reproducibility", "caveats",
                       "counterfactual_tag", "revision_history"}


def test_unknown_check_type(spark):
    assert "check_type:valid" in fail_checks(spark, finding(check_type="median"))


def test_observed_needs_measurement_ref(spark):
    assert "counterfactual:observed_needs_ref" in fail_checks(spark, finding(counterfactual_tag="OBSERVED"))
    assert fail_checks(spark, finding(counterfactual_tag="OBSERVED", measurement_ref="x.py:L1")) == set()


def test_duplicate_id(spark):
    assert "ids:unique" in fail_checks(spark, finding(), finding())


def test_suffix_ids_are_valid(spark):
    assert fail_checks(spark, finding(id="F-010"), finding(id="F-010b")) == set()
    assert "ids:format" in fail_checks(spark, finding(id="F-10"))


def test_measure_must_resolve(spark):
    assert "code_path:resolves" in fail_checks(spark, finding(code_path="analysis/02_profile.py:nope"))


def test_empty_revision_history(spark):
    assert "revision_history:nonempty" in fail_checks(spark, finding(revision_history=[]))


def test_code_path_forms(spark):
    assert "code_path:line_ref" in fail_checks(spark, finding(code_path="analysis/02_profile.py:L10-L20"))
    assert "code_path:form" in fail_checks(spark, finding(code_path="analysis/02_profile.py"))
    assert "code_path:form" in fail_checks(spark, finding(code_path="analysis/02_profile.py:123"))
    assert fail_checks(spark, finding(code_path="analysis/02_profile.py:L2_norm")) == set()
    assert fail_checks(spark, finding(check_type="manual", code_path="notes.md:L1-L2")) == set()


def test_conditional_payloads(spark):
    assert "conditional:value" in fail_checks(spark, finding(value=...))
    assert fail_checks(spark, finding(value=0)) == set()
    assert "conditional:value" in fail_checks(spark, finding(check_type="boolean", value=1))
    assert fail_checks(spark, finding(check_type="boolean", value=True)) == set()
    assert "conditional:distribution" in fail_checks(spark, finding(check_type="distribution", distribution={}))
    assert "conditional:matrix" in fail_checks(spark, finding(check_type="matrix", matrix=[]))
    assert "conditional:quote" in fail_checks(spark, finding(check_type="quote_provenance", quote="x"))


def test_tolerance_shapes(spark):
    got, _ = fails(spark, finding(tolerance={"abs": 0.01}))
    assert ("tolerance:custom", "WARN") in got and not {c for c, s in got if s == "FAIL"}
    assert "tolerance:loose" in fail_checks(spark, finding(tolerance={"abs": 5}))
    assert "tolerance:shape" in fail_checks(spark, finding(tolerance=0.5))
    assert "tolerance:value" in fail_checks(spark, finding(tolerance={"rel": -1}))


def test_fingerprint_consistency_and_unpinned(spark):
    a = finding(input={"sources": [{"path": "sessions", "sha256": "aaa"}], "columns": []})
    b = finding(id="F-002", input={"sources": [{"path": "sessions", "sha256": "bbb"}], "columns": []})
    assert "source_hash:consistency" in fail_checks(spark, a, b)
    got, _ = fails(spark, finding())
    assert ("source_hash:unpinned", "WARN") in got


def test_verdict_strict(spark):
    led = ledger_df(spark, finding())
    v = structural_checks(led, NAMES).unionByName(group_checks(led))
    assert verdict(v, led).collect()[0]["exit_code"] == 0
    assert verdict(v, led, strict=True).collect()[0]["exit_code"] == 1


def test_malformed_documents_never_crash(spark):
    led = ledger_df(spark, finding(), "{broken", "7")
    checks = {r["check"] for r in document_violations(led).collect()}
    assert checks == {"ledger:parses", "ledger:shape"}
    raw = spark.createDataFrame([("p", '[{"id": "F-001"}, 7]'), ("q", "{bad"), ("r", '{"id": 1}')],
                                "project string, text string")
    rows, viol = split_json_arrays(raw)
    assert rows.count() == 1
    assert sorted(r["check"] for r in viol.collect()) == ["ledger:parses", "ledger:shape", "ledger:shape"]


def test_json_array_files(spark, tmp_path):
    import json

    from claimledger.sources.ledger_io import read_json_array_files
    (tmp_path / "good.json").write_text(json.dumps([finding(), finding(id="F-002")], indent=1))
    (tmp_path / "bad.json").write_text('[{"id": "F-003"}, 7')
    (tmp_path / "mixed.json").write_text('[{"id": "F-004"}, 7]')
    (tmp_path / "object.json").write_text('{"id": "F-005"}')
    ledger, bad = read_json_array_files(spark, str(tmp_path), "p")
    assert sorted(json.loads(r["doc"])["id"] for r in ledger.collect()) == ["F-001", "F-002", "F-004"]
    assert sorted((r["check"], r["detail"]) for r in bad.collect()) == [
        ("ledger:parses", "ledger text is not valid JSON"), ("ledger:shape", "element 1 is not a JSON object"),
        ("ledger:shape", "expected a top-level array")]


def test_written_ledgers(spark, tmp_path):
    import pytest

    from claimledger.sources.ledger_io import read_ledger, write_ledger
    root = str(tmp_path / "ledger")
    with pytest.raises(FileNotFoundError):
        read_ledger(spark, root)
    write_ledger(ledger_df(spark, finding()), root)
    write_ledger(ledger_df(spark, finding(), finding(id="F-002")), root)
    assert read_ledger(spark, root).count() == 2
    for bad in ('{"id": "F-003", "value": NaN}', "{broken", "7", '{"distribution": {"mean": "NaN"}}',
                '{"matrix": [[1, "Infinity"]]}'):
        with pytest.raises(ValueError):
            write_ledger(ledger_df(spark, bad), root)
    assert read_ledger(spark, root).count() == 2


def test_documents_keep_their_open_fields(spark):
    import json

    from claimledger.operators.registration import current_ledger, register, update
    none = spark.createDataFrame([], "project string, doc string")
    f = finding(owner="ann", input={"sources": [{"path": "a", "rows": 7}], "columns": [], "note": "x"},
                reproducibility={"filters": [], "row_count_after_filter": 10, "seed": 3})
    acc, _ = register(none, ledger_df(spark, f), "r", "t0")
    d = json.loads(acc.collect()[0]["doc"])
    assert (d["owner"], d["input"]["note"], d["input"]["sources"][0]["rows"], d["reproducibility"]["seed"]) == ("ann", "x", 7, 3)
    changes = lambda *docs: spark.createDataFrame([("p", "F-001", x) for x in docs],
                                                  "project string, id string, doc string")
    new, rej = update(acc, changes('{"decisions": ["DR-009"], "addresses": ["A-1"], "n": 7, "owner": "bob", "id": "F-9"}'), "u", "t1")
    d = json.loads(current_ledger(acc.unionByName(new)).collect()[0]["doc"])
    assert (d["id"], d["decisions"], d["addresses"], d["n"], d["owner"]) == ("F-001", ["DR-009"], ["A-1"], 7, "bob")
    assert [h["reason"] for h in d["revision_history"]] == ["r", "u"] and rej.count() == 0
    for doc in ('{"check_type": "bogus"}', '{"counterfactual_tag": "MAYBE"}', "{broken", "7"):
        new, rej = update(acc, changes(doc), "u", "t1")
        assert new.count() == 0 and rej.count() > 0
    new, rej = update(acc, changes('{"n": 1}', '{"n": 2}'), "u", "t1")
    assert new.count() == 0 and [r["reason"] for r in rej.collect()] == ["update:duplicate_in_batch"]


def test_the_first_copy_in_a_batch_is_taken(spark):
    from claimledger.operators.registration import register
    none = spark.createDataFrame([], "project string, doc string")
    acc, rej = register(none, ledger_df(spark, finding(claim="a"), finding(claim="b"), finding(claim="b")), "r", "t0")
    assert [r["id"] for r in acc.collect()] == ["F-001"]
    assert [r["reason"] for r in rej.collect()] == ["ids:duplicate_in_batch"]


def test_shown_values(spark):
    from pyspark.sql import functions as F

    from claimledger.operators.status import format_value
    cases = [("scalar", 1234.5, "1,234"), ("scalar", 123456.7, "1.235e+05"), ("scalar", 1e-13, "1e-13"),
             ("scalar", 1000000000.5, "1e+09"), ("rate", 1234567.0, "1,234,567"), ("proportion", 0.12345, "12.3%"),
             ("scalar", -0.00012345, f"{-0.00012345:,.4g}"), ("scalar", 0.0, "0"), ("distribution", None, "distribution (see detail)"),
             ("matrix", None, "matrix (see detail)"), ("scalar", None, None)]
    df = spark.createDataFrame([(k, v) for k, v, _ in cases], "k string, v double").coalesce(1)
    assert [r["s"] for r in df.select(format_value(F.col("k"), F.col("v")).alias("s")).collect()] == [w for _, _, w in cases]
    flag = spark.createDataFrame([("boolean", None, True)], "k string, v double, f boolean")
    assert flag.select(format_value(F.col("k"), F.col("v"), F.col("f")).alias("s")).collect()[0]["s"] == "True"


def test_wrapped_records_and_trees(spark, tmp_path):
    from claimledger.sources.scan import scan_json_records, scan_tree
    rows = [(1, '{"k": 1}'), (2, '{"meta": {"n": 2}, "data": [{"k": 2}, {"k": 3}]}'), (3, '[{"k": 4}]'), (4, "{broken"), (5, None)]
    got = scan_json_records(spark.createDataFrame(rows, "i int, j string"), "j", "k bigint").collect()
    assert sorted((r["i"], r["k"] or 0) for r in got) == [(1, 1), (2, 2), (2, 3), (3, 4), (4, 0), (5, 0)]
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "empty.csv").write_text("a,b\n")
    (tmp_path / "UP.CSV").write_text("a,b\n1,2\n")
    (tmp_path / "w.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "notes.md").write_text("# no data")
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["rows"]) for r in scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"x.csv": ("csv", 2), "empty.csv": ("csv", 0), "UP.CSV": ("csv", 1), "w.json": ("json", 2)}


def test_exact_doubles(spark):
    import struct

    from pyspark.sql import functions as F

    from claimledger.sources.fingerprint import content_fingerprint, exact_double
    values = [0.0, -0.0, 1.0, -1.5, 1e-9, 4e-7, 1e33, 5e-324, -5e-324, 2.0 ** 1023, 1.7976931348623157e308, 0.1,
              2.2250738585072014e-308, 2.0 ** -1000, 2.0 ** 1000, 1 - 2 ** -53, 1 + 2 ** -52, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [r["t"] for r in df.select(exact_double(F.col("v")).alias("t")).collect()]
    for v, t in zip(values, got):
        if "p" in t:
            m, e = t.split("p")
            from fractions import Fraction
            assert Fraction(int(m)) * Fraction(2) ** int(e) == Fraction(v) and struct.pack("<d", v)
    assert got[0] == got[1] == "0" and got[-2:] == ["Infinity", "-Infinity"]
    one, two = (spark.createDataFrame([(v,)], "v double") for v in (1.0, 1.0 + 1e-9))
    assert content_fingerprint(one).collect() != content_fingerprint(two).collect()


def test_a_replayed_batch_is_the_same(spark, tmp_path):
    import json

    from claimledger.streaming.gate import start_gate
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps(finding()) + "\n" + json.dumps(finding(id="F-002", value=...)) + "\n")
    paths = [str(tmp_path / x) for x in ("acc", "rej")]
    for k in range(2):  # a new checkpoint: batch 0 runs again over its own output
        start_gate(spark, str(inbox), *paths, str(tmp_path / f"ck{k}"), "t0").awaitTermination(120)
        acc, rej = (spark.read.parquet(p).collect() for p in paths)
        assert [r["id"] for r in acc] == ["F-001"] and [(r["id"], r["reason"]) for r in rej] == [("F-002", "conditional:value")]
