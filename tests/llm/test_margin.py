"""The narrow saving comes from every reserved document."""

import pytest
from pyspark.sql import functions as F

from claimledger.llm import language


def test_every_reserved_document_sets_the_narrow_saving(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "_narrow", lambda labelled, dictionaries: seen.append(labelled.count()) or 0.02)
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a house by the sea")
                                      .otherwise("une maison de la mer").alias("text"),
                                      F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    assert language.learn(docs).narrow == 0.02
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("margin"))
    assert seen == [docs.where(F.pmod(h, F.lit(language.RESERVE)) == 0).count()]


def test_the_narrow_saving_is_the_quantile_of_all(spark):
    dictionaries = language.Dictionaries({"en": b"a house by the sea and the wind", "fr": b"une maison de la mer et du vent"})
    model = language.Model(dictionaries)
    texts = ["a house by the sea", "a house by the wind", "une maison de la mer", "xyz qrs tuv wxy", "the sea and vent"] * 40
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    savings = sorted(model.predict(t)[2] for t in texts)
    want = max(language.MIDDLE, savings[int(language.LOST * len(savings))])
    assert language._narrow(docs, dictionaries) == pytest.approx(want, abs=2 / language.STEPS)
