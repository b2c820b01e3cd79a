"""Operator 12: held-out accuracy, the defined cases, and a plain score."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from claimledger.llm import quality
from claimledger.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    got = quality.q_quality(spark, SF)
    return got.join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id", "left").toPandas()


def test_held_out_accuracy(spark, scored):
    assert len(scored) == table(spark, SF, "documents").count() and scored.score.between(0, 1).all()
    assert (scored.predicted == (scored.score >= 0.5)).all()
    out = scored[scored.held_out & scored.quality.notna()]
    right = out.predicted == out.quality
    assert right.mean() >= 0.96 and right[out.quality == 1].mean() >= 0.98 and right[out.quality == 0].mean() >= 0.85
    # calibrated: the mean score is near the share of good documents
    assert abs(out.score.mean() - out.quality.mean()) <= 0.03


def test_form():
    assert quality.form("Der Der Der Tag 42!!") == b"Aaa = = Aaa 99!!"
    assert quality.form(None) == b"" and quality.form("a\ta \n a b") == b"a = = a"


def test_score_is_the_normalised_difference():
    good, bad = b"aaaa aaa aa. Aaaa aaa\n" * 40, b"AAA!! AAA!! AA!! | aa | = = = = $$$ " * 30
    model = quality.Model(quality.Quality((bad, good), 40.0, 0.25))
    text = "Some words, and SOME!! MORE!! of of of them. " * 20
    raw, sizes = quality.form(text), []
    for d in (bad, good):
        z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                     write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(z.compress(raw[i:i + 128])) for i in range(0, len(raw), 128)))
    assert abs(model.difference(text) - (sizes[0] - sizes[1]) / sum(sizes)) < 0.01
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(40 * model.difference(text) + 0.25))))
    assert model.score("") == model.score(None) == pytest.approx(1 / (1 + np.exp(-0.25)))


def labelled(spark, n=300):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("etaoinsh", k=rng.randint(2, 8)))
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(60))
        rows.append((i, t if i % 3 else " ".join(w.upper() + "!!" for w in t.split()), i % 3 and 1))
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int"), rows)


def test_learning_cases(spark, odd, empty):
    docs, labels, rows = labelled(spark)
    learned = quality.learn(docs.unionAll(docs), labels.unionAll(labels))  # repeated rows count once
    assert learned == quality.learn(docs, labels) and all(len(d) <= quality.DICTIONARY_BYTES for d in learned.dictionaries)
    got = {r.doc_id: r.predicted for r in quality.score(docs, learned).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 0.99 * len(rows)
    out = quality.score(odd, learned)  # it has a column named score
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    by = {r.doc_id: r.score for r in out.collect()}
    assert len(by) == 11 and by[3] == by[4] and 0 <= by[10] <= 1
    assert quality.score(empty, learned).count() == 0
    none = labels.where("false")
    assert quality.Model(quality.learn(docs, none)).score("x") == 0.5
    assert quality.Model(quality.learn(docs, labels.where("label = 1"))).score("x") > 0.98
    assert quality.Model(quality.learn(empty, labels)).score("x") > 0.5
    odd_labels = labels.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 7).cast("int").alias("label"))
    assert quality.Model(quality.learn(docs, odd_labels)).score("x") == 0.5
