"""Records without a schema, types of raw values, closures of lineage, refreshes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimledger.operators import lineage as ln
from claimledger.sources import refresh as rf
from claimledger.sources.fingerprint import byte_fingerprint
from claimledger.sources.records import flatten_records, record_schema, sample_types

MANIFESTS = ("project string, output string, output_sha256 string, sources map<string,string>, "
             "rules_fingerprint string")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- records

def test_flatten_nested_lists_and_odd_names(spark):
    df = spark.createDataFrame([
        (1, '{"a": {"b": 1, "c d": "x", "it\'s": 5}, "l": [1, 2], "n": null, "id": 9}'),
        (2, '{"a": {"b": 2.5, "e": {"f": true}}, "o": {}}'), (3, "nope"), (4, None),
        (5, '[{"a": {"b": 3}}, {"l": []}]'), (6, "3"), (7, '{"rows": [{"a": {"b": 4}}]}')], "id long, doc string")
    got = rows(flatten_records(df, "doc").orderBy("id", "`a.b`"))
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 5, 6, 7]
    assert got[0]["a.b"] == 1.0 and got[0]["a.c d"] == "x" and got[0]["a.it's"] == 5
    assert got[0]["l"] == "[1,2]" and got[0]["n"] is None and got[0]["id_"] == 9
    assert got[1]["a.b"] == 2.5 and got[1]["a.e.f"] is True and got[1]["o"] == "{}"
    assert all(got[i]["a.b"] is None for i in (2, 3, 6))
    assert {r["a.b"] for r in got if r["id"] == 5} == {None, 3.0} and got[7]["a.b"] == 4.0


def test_flatten_fields_of_several_kinds(spark):
    df = spark.createDataFrame([('{"m": 1}',), ('{"m": "t"}',), ('{"m": {"z": 1}}',), ('{"m": null}',), ("{}",)], "doc string")
    got = [r["m"] for r in rows(flatten_records(df, "doc"))]
    assert sorted(got, key=str) == sorted(["1", "t", '{"z":1}', None, None], key=str)


def test_flatten_without_any_record(spark):
    df = spark.createDataFrame([(1, "nope"), (2, None)], "id long, doc string")
    assert record_schema(df, "doc").fields == []
    assert rows(flatten_records(df, "doc").orderBy("id")) == [{"id": 1}, {"id": 2}]
    assert flatten_records(df.where("false"), "doc").count() == 0


@pytest.mark.parametrize("values, dtype, nulls", [
    (["1", "-20", None], "integer", 1), (["1", "2.5", "1e3"], "double", 0), (["2024-01-31", " "], "date", 1),
    (["2024-01-31", "2024-01-31T10:00:00Z"], "timestamp", 0), (["True", "false"], "boolean", 0),
    (["true", "1"], "text", 0), (["2024-13-01", "2024-01-01"], "text", 0), ([None, ""], "null", 2), (["1", "n/a"], "text", 0)])
def test_types_of_raw_values(spark, values, dtype, nulls):
    got = rows(sample_types(spark.createDataFrame([(v,) for v in values], "`a.b` string")))
    assert got == [{"column": "a.b", "dtype": dtype, "rows": len(values), "nulls": nulls, "sampled": False}]


def test_types_of_a_sample(spark):
    df = spark.createDataFrame([(str(i),) for i in range(10)], "v string")
    assert rows(sample_types(df, 4)) == [{"column": "v", "dtype": "integer", "rows": 4, "nulls": 0, "sampled": True}]
    assert rows(sample_types(df, 10))[0]["sampled"] is False
    assert rows(sample_types(df.where("false"), 4)) == [{"column": "v", "dtype": "null", "rows": 0, "nulls": 0, "sampled": False}]


# ---------------------------------------------------------------- lineage

def graph(spark, edges, rules="r1"):
    """Manifests from {output: sources}; every path's fingerprint is its own name."""
    return spark.createDataFrame([("p", o, o, {s: s for s in ss}, rules) for o, ss in edges.items()], MANIFESTS)


def current(spark, paths, **changed):
    return spark.createDataFrame([(p, changed.get(p, p)) for p in paths], "path string, sha256 string")


CHAIN = {"b": ["a"], "c": ["b"], "d": ["c", "x"], "e": ["x"]}


def test_a_change_at_the_bottom_marks_all_above(spark):
    m = graph(spark, CHAIN)
    got = rows(ln.transitive_freshness(m, current(spark, "abcdex", a="new"), "r1", fast=False))
    assert {(r["finding_id"], r["severity"], r["detail"]) for r in got} == {
        ("c", "FAIL", "made from a stale table 1 build(s) before"), ("d", "FAIL", "made from a stale table 2 build(s) before")}
    assert ln.transitive_freshness(m, current(spark, "abcdex"), "r1", fast=False).count() == 0


def test_missing_outputs_and_other_rules_mark_dependants(spark):
    m = graph(spark, CHAIN)
    gone = rows(ln.transitive_freshness(m, current(spark, "acdex"), "r1", fast=True))
    assert {(r["finding_id"], r["severity"]) for r in gone} == {("c", "WARN"), ("d", "WARN")}
    # an absent raw source can't be verified and marks nothing
    assert ln.transitive_freshness(m, current(spark, "bcdex"), "r1", fast=False).count() == 0
    # built under other rules, every output is stale by its own pins: nothing is left to mark
    assert ln.transitive_freshness(m, current(spark, "abcdex"), "r2", fast=False).count() == 0
    some = graph(spark, {"b": ["a"]}, "r1").union(graph(spark, {"c": ["b"], "e": ["x"]}, "r2"))
    other = rows(ln.transitive_freshness(some, current(spark, "abcex"), "r2", fast=False))
    assert [r["finding_id"] for r in other] == ["c"]


def test_lineage_of_claims_goes_to_the_raw_sources(spark):
    claims = spark.createDataFrame([("p", "F1", [("d",)]), ("p", "F2", [("raw",)]), ("p", "F3", [])],
                                   "project string, id string, sources array<struct<path:string>>")
    got = {(r["id"], r["source"], r["raw_source"], r["depth"]) for r in rows(ln.claim_lineage(claims, graph(spark, CHAIN)))}
    assert got == {("F1", "d", "a", 3), ("F1", "d", "x", 1), ("F2", "raw", None, None), ("F3", None, None, None)}


def test_cycles_are_found_and_end(spark):
    m = graph(spark, {**CHAIN, "s": ["s"], "u": ["v"], "v": ["w"], "w": ["u", "a"], "after": ["u"], "before": ["a"]})
    got = {(r["finding_id"], r["detail"]) for r in rows(ln.cycles(m))}
    assert got == {("s", "made from itself over 1 build(s)")} | {(x, "made from itself over 3 build(s)") for x in "uvw"}
    assert ln.cycles(graph(spark, CHAIN)).count() == 0
    assert ln.cycles(m.where("false")).count() == 0
    closed = {(r["path"], r["depth"]) for r in rows(ln.stale_closure(m, spark.createDataFrame([("u",), (None,)], "path string")))}
    assert closed == {("u", 0), ("w", 1), ("after", 1), ("v", 2)}


def test_ancestors_equal_a_plain_search(spark):
    rng = random.Random(3)
    edges = {f"n{i}": sorted({f"n{rng.randrange(0, 14)}" for _ in range(rng.randrange(1, 3))}) for i in range(4, 14)}
    got = {(r["output"], r["source"]): r["depth"] for r in rows(ln.ancestors(graph(spark, edges)))}
    want = {}
    for o in edges:
        level, depth = {o}, 0
        while level:
            depth += 1
            level = {s for x in level for s in edges.get(x, ()) if (o, s) not in want}
            want |= {(o, s): depth for s in level}
    assert got == want


# ---------------------------------------------------------------- refresh

def day_totals(df):
    return df.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))


def test_a_refresh_equals_a_full_build_and_builds_only_what_changed(spark):
    before = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3), ("d3", 4), (None, 5)], "day string, v long")
    now = spark.createDataFrame([("d1", 2), ("d1", 1), ("d2", 30), ("d4", 6), ("d4", 6), (None, 5)], "day string, v long")
    built = []

    def build(df):
        built.append({r["day"] for r in df.select("day").distinct().collect()})
        return day_totals(df)

    table, plan, new = rf.refresh(day_totals(before), now, rf.pins(before, "day"), "day", build)
    assert sorted(map(str, table.collect())) == sorted(map(str, day_totals(now).collect()))
    assert built == [{"d2", "d4"}]
    assert {(r["day"], r["action"]) for r in plan.collect()} == {
        ("d1", "kept"), ("d2", "rebuilt"), ("d3", "removed"), ("d4", "added"), (None, "kept")}
    again, plan, _ = rf.refresh(table, now, new, "day", build)
    assert built[-1] == set() and {r["action"] for r in plan.collect()} == {"kept"}
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))


def test_a_refresh_from_and_to_nothing(spark):
    now = spark.createDataFrame([("d1", 1)], "day string, v long")
    none = now.where("false")
    table, _, _ = rf.refresh(day_totals(none), now, rf.pins(none, "day"), "day", day_totals)
    assert table.collect() == day_totals(now).collect()
    table, plan, _ = rf.refresh(day_totals(now), none, rf.pins(now, "day"), "day", day_totals)
    assert table.count() == 0 and [r["action"] for r in plan.collect()] == ["removed"]


# ---------------------------------------------------------------- byte fingerprints

def test_byte_fingerprint_equals_hashlib(spark, tmp_path):
    data = random.Random(5).randbytes(3_000_001)
    (tmp_path / "one.bin").write_bytes(data)
    got = byte_fingerprint(spark, str(tmp_path / "one.bin")).first()
    assert (got["n_files"], got["bytes"], got["sha256"]) == (1, len(data), hashlib.sha256(data).hexdigest())
    (tmp_path / "two.bin").write_bytes(b"x")
    both = byte_fingerprint(spark, str(tmp_path)).first()
    assert (both["n_files"], both["bytes"]) == (2, len(data) + 1) and both["sha256"] != got["sha256"]
