"""Python measures beside built-in ones, and suspected sentinels."""

import math

import pytest
from pyspark.sql import functions as F

from claimledger.operators import measures as ms
from claimledger.operators.profile import sentinel_profile
from claimledger.plans.evaluate import analyse, assemble, evaluate


def both_kinds():
    return [ms.mean("mean", "v"), ms.median("median", "v"),
            ms.python_measure("span", lambda v: v.max() - v.min(), ["v"]),
            ms.python_measure("ordered", lambda v, w: bool((v <= w).all()), ["v", "w"], "boolean"),
            ms.python_fold("var", lambda v: (v.count(), v.sum(), (v * v).sum()),
                           lambda n, s, q: None if n < 2 else (q - s * s / n) / (n - 1), ["v"], 3)]


def results(df, measures, keys=None):
    _, values = evaluate(df, measures, keys)
    return {tuple(r[k] for k in keys or []) + (r.measure,): r.flag if r.kind == "boolean" else r.num
            for r in assemble(values, measures, keys).collect()}


def test_mixed_measures_by_key(spark):
    rows = [("a", float(i), float(i + (i != 7))) for i in range(50)] + [("b", 2.0, 3.0)] + [(None, 1.0, 0.0), (None, None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    got = results(df, both_kinds(), ["k"])
    a = [r[1] for r in rows if r[0] == "a"]
    m = sum(a) / len(a)
    assert got["a", "mean"] == m and got["a", "median"] == 24.5 and got["a", "span"] == 49.0 and got["a", "ordered"] is True
    assert math.isclose(got["a", "var"], sum((x - m) ** 2 for x in a) / 49)
    assert got["b", "var"] is None and got["b", "span"] == 0.0 and got["b", "ordered"] is True
    assert got[None, "ordered"] is False and got[None, "mean"] == 1.0 and got[None, "span"] == 0.0


def test_folds_see_shards_of_a_hot_group(spark):
    """The partial function never gets the whole of a group that lies in many partitions."""
    df = spark.range(0, 900, 1, 6).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("v"))
    largest = ms.python_fold("n", lambda v: (float(len(v)), float(len(v) > 200)), lambda n, over: n if over == 0 else -1, ["v"], 2)
    assert results(df, [largest], ["k"]) == {("hot", "n"): 900.0}


def test_no_rows_and_broken_measures(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "v double, w double")
    got = results(df.limit(0), both_kinds())
    assert got["span",] is None and got["ordered",] is None and got["var",] is None
    good, bad = analyse(df, [*both_kinds(), ms.python_measure("gone", len, ["nope"])])
    assert len(good) == 5 and list(bad) == ["gone"]


@pytest.fixture()
def seeded(spark):
    rows = [(i, -1.0 if i % 10 == 0 else 50.0 + i % 97, i % 3, "" if i % 20 == 0 else f"name {i}", f"2024-01-{1 + i % 28:02d}")
            for i in range(2000)]
    return spark.createDataFrame(rows, "id long, x double, code int, name string, d string").withColumn("d", F.expr(
        "CASE WHEN id % 25 = 0 THEN date'1900-01-01' ELSE cast(d AS date) END"))


def test_sentinels_are_found_and_clean_columns_left_alone(seeded):
    got = {(r.column, r.value, r.n, r.position) for r in sentinel_profile(seeded).collect()}
    assert got == {("x", "-1.0", 200, "below"), ("name", "", 100, "below"), ("d", "1900-01-01", 80, "below")}
    assert sentinel_profile(seeded, ["id", "code"]).collect() == []
    assert sentinel_profile(seeded.limit(0)).collect() == []
    assert sentinel_profile(seeded.select(F.array("id").alias("a"))).collect() == []
