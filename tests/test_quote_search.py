"""Corpus-wide quotes, duplicated keys, register parts and shown values."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimledger.operators import quote_search as qs
from claimledger.operators.contract import duplicate_keys, quarantine_duplicates
from claimledger.operators.status import format_value
from claimledger.operators.textops import parts


def brute(quotes, docs):
    out = []
    for q, quote in quotes:
        for loc, text in docs:
            at = [i for i in range(len(text or "") - len(quote or "") + 1) if quote and text.startswith(quote, i)]
            if at:
                out.append((q, loc, at[0], len(at)))
    return sorted(out)


def test_quotes_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab é\n😀", k=rng.randint(0, 300))) for _ in range(40)]
    texts += ["ab" * 200, "x" * 100, None, "", texts[0]]
    docs = list(enumerate(texts))
    quotes = [(i, t[k:k + n]) for i, (t, k, n) in enumerate(
        (rng.choice(texts[:40]), rng.randint(0, 100), rng.choice([1, 2, 3, 4, 6, 10, 11, 15, 22, 23, 24, 40, 90])) for _ in range(120))]
    quotes += [(200, "abab" * 8), (201, "x" * 30), (202, "not there at all, anywhere"), (203, None), (204, ""), (205, "x" * 30), (206, "zz")]
    got = qs.find_quotes(spark.createDataFrame(quotes, "quote_id long, quote string"),
                         spark.createDataFrame(docs, "locator long, text string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == brute(quotes, docs)
    none = spark.createDataFrame([], "quote_id long, quote string")
    assert qs.find_quotes(none, spark.createDataFrame(docs, "locator long, text string")).collect() == []
    empty = spark.createDataFrame([], "locator long, text string")
    assert qs.find_quotes(spark.createDataFrame(quotes, "quote_id long, quote string"), empty).collect() == []


@pytest.mark.parametrize("size,window", qs.TIERS)
def test_kept_grams_are_the_smallest_of_each_window(size, window):
    rng = random.Random(size)
    text = "".join(rng.choices("abcé", k=200)) + "aaaa" * 20
    every, _ = qs.grams(text, size, 1)
    h, at = qs.grams(text, size, window)
    want = sorted({k + int(np.argmin(every[k:k + window])) for k in range(len(every) - window + 1)})
    assert at.tolist() == want and h.tolist() == [every[i] for i in want]
    # a long enough piece keeps its grams wherever it stands
    piece = text[50:50 + size + window + 20]
    assert set(qs.grams(piece, size, window)[1] + 50) <= set(at.tolist())
    assert len(qs.grams(text[:size + window - 2], size, window)[0]) == 0


def test_claims_without_a_locator(spark):
    claims = spark.createDataFrame([("F-1", "the quick brown fox jumps"), ("F-2", ""), ("F-3", "no such words")], "id string, quote string")
    corpus = spark.createDataFrame([("a", "so the quick brown fox jumps."), ("b", "the quick brown fox jumps")], "locator string, text string")
    got = {r.id: (r.quote_reason, r.documents) for r in qs.unlocated_quote_reasons(claims, corpus).collect()}
    assert got == {"F-1": ("ok", 2), "F-2": ("quote_missing", 0), "F-3": ("quote_not_found", 0)}


def test_duplicate_keys(spark):
    rows = [(1, None, "a"), (1, None, "b"), (1, 2, "c"), (2, 2, "d"), (None, None, "e"), (None, None, "f"), (None, 3, "g"), (None, 3, "h")]
    df = spark.createDataFrame(rows, "`a b` int, y int, v string")
    assert sorted(map(tuple, duplicate_keys(df, ["a b", "y"]).collect()), key=str) == [(1, None, 2), (None, 3, 2)]
    good, bad = quarantine_duplicates(df, ["a b", "y"])
    assert {r.v for r in good.collect()} == set("cdef") and {r.v for r in bad.collect()} == set("abgh")
    assert duplicate_keys(df.limit(0), ["y"]).collect() == []


def test_parts_are_linear_in_lines(spark):
    text = "\n".join(f"### F-{i:03d} — t" if i % 10 == 0 else f"line {i}" for i in range(4000))
    df = spark.createDataFrame([(text,), (None,), ("",), ("no head",)], "text string")
    cut = df.select(F.inline(parts(F.col("text"), lambda x: x.rlike(r"^###\s+"))))
    assert cut.count() == 400
    t = time.time()
    rows = cut.orderBy("pos").collect()
    assert time.time() - t < 3 and [r.pos for r in rows] == list(range(0, 4000, 10))
    assert rows[1].body == "\n".join(f"line {i}" for i in range(11, 20)) and rows[-1].body.endswith("line 3999")


def test_large_integral_values_are_shown_whole(spark):
    rows = [("scalar", 1e20), ("scalar", 1234567.0), ("scalar", 0.125), ("rate", -3.0), ("scalar", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double").select(format_value(F.col("k"), F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["100,000,000,000,000,000,000", "1,234,567", "0.125", "-3", "2.5"]
