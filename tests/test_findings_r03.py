"""Work that must be done once a row, and tables that must stay small."""

import json

from conftest import finding
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimledger.operators import measures as ms
from claimledger.operators import quote_search
from claimledger.operators import rules as rl
from claimledger.operators.registration import register
from claimledger.plans.evaluate import evaluate_groups
from claimledger.sources.ledger_io import read_ledger, write_ledger



def counted_ledger(spark, n):
    """n findings whose text is built by a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)
    text = json.dumps(finding())

    def build(i):
        calls.add(1)
        return text.replace("F-001", f"F-{i + 1:03d}")

    doc = F.udf(build, StringType())("id")
    return spark.range(n).select(F.lit("p").alias("project"), doc.alias("doc")), calls


def test_a_written_ledger_is_computed_once(spark, tmp_path):
    led, calls = counted_ledger(spark, 20)
    write_ledger(led, str(tmp_path / "led"))
    assert calls.value == 20
    assert read_ledger(spark, str(tmp_path / "led")).count() == 20


def test_a_registered_batch_is_computed_once(spark):
    led, calls = counted_ledger(spark, 20)
    none = spark.createDataFrame([], "project string, doc string")
    accepted, rejected = register(none, led, "batch", "2026-01-01T00:00:00Z")
    assert accepted.select("project", "id").distinct().count() == 20
    assert rejected.count() == 0
    assert calls.value == 20


def test_places_of_common_grams_are_not_stored(spark, monkeypatch):
    """Only the places of a quote's rarest gram are stored, however often its others stand in the corpus."""
    stored, keep = [], quote_search.materialize

    def recorded(df):
        out = keep(df)
        stored.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(quote_search, "materialize", recorded)
    corpus = spark.createDataFrame([(i, "the cat " * 60 + ("the zq" if i == 7 else "")) for i in range(30)],
                                   "locator long, text string")
    quotes = spark.createDataFrame([("q", "the zq"), ("r", "cat the x")], "quote_id string, quote string")
    got = quote_search.find_quotes(quotes, corpus).collect()
    assert [tuple(r) for r in got] == [("q", 7, 480, 1)]
    assert sum(n for columns, n in stored if "did" in columns and "at" in columns) == 1


def test_a_group_is_evaluated_for_its_own_measures_alone(spark):
    """The share of 1 / x fails where x is 0; only the group without such rows asks for it."""
    df = spark.createDataFrame([(i, float(i % 4), "a" if i % 2 else "b") for i in range(40)], "i long, x double, k string")
    groups = [([], None), ([rl.drop_equal("DR-001", "x", 0.0)], None), ([rl.mask_equal("DR-002", "x", 0.0)], "k")]
    measures = [ms.count_rows("n"), ms.mean("inverse", F.lit(1.0) / F.col("x")), ms.median("mid", "x"), ms.rate("per", "x")]
    rows, values = evaluate_groups(df, groups, measures, {"n": [0], "inverse": [1], "mid": [0, 2], "per": [1]})
    assert sorted((r["_g"], r["_gk"] or "", r["rows"]) for r in rows.collect()) == [
        (0, "", 40), (1, "", 30), (2, "a", 20), (2, "b", 20)]
    got = {(r["_g"], r["_gk"], r["measure"]): r["num"] for r in values.collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {
        (0, None, "n"): 40.0, (1, None, "inverse"): round((1 + 1 / 2 + 1 / 3) / 3, 6), (1, None, "per"): 10.0,
        (0, None, "mid"): 1.5, (2, "a", "mid"): 2.0, (2, "b", "mid"): 2.0}
