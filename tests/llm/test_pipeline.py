"""The corpus pipeline: every stage against brute force on small tables."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer
import public_tokenizers

import corpus_pipeline
from claimledger.llm import language, tokens
from claimledger.llm.common import materialize, table

from .test_joins import groups, shingle_set
from .test_mixing_chat import water
from .conftest import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination",
                                                      "mixing", "token output"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_language_stage(stages):
    model = language.Model.of(language.learn(stages[0].select("doc_id", "text", "lang")))
    want = {r.doc_id for r in stages[0].collect() if model.predict(r.text)[2] >= language.NARROW}
    assert {r.doc_id for r in stages[1].collect()} == want and len(want) >= 0.95 * stages[0].count()


def test_near_duplicate_stage(stages):
    rows = stages[1].orderBy("doc_id").collect()
    sets = [shingle_set(r.text, 5) for r in rows]
    label = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                               if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert {r.doc_id for r in stages[2].collect()} == {rows[i].doc_id for i in range(len(rows)) if label[i] == i}


def test_decontamination_stage(spark, stages):
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() or c >= "\x80" else " " for c in t.lower()).split()) + " "
    items = [norm(r.text) for r in table(spark, SF, "benchmark").collect()]
    before, after = ({r.doc_id: norm(r.text) for r in s.collect()} for s in stages[2:4])
    held = {k for k, t in before.items() if any(i in t for i in items)}
    assert set(after) <= set(before) - held and len(after) >= len(before) - len(held) - 1


def test_mixing_stage(stages):
    rows, out = stages[3].collect(), stages[4].collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    names, taken, copies = sorted(size), {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    longest = {s: max(len(words(r.text)) for r in rows if r.source == s) for s in names}
    for s, t in zip(names, water([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])):
        assert abs(taken.get(s, 0) - t) <= 2 * longest[s]
    assert max(copies.values()) <= 3 and {(r.doc_id, r.text) for r in out} <= {(r.doc_id, r.text) for r in rows}


def test_token_stage(stages):
    t, at = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY)), 0
    want = []
    for r in sorted(stages[4].collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in stages[5].orderBy("start").collect()] == want


def test_run_and_empty_documents(spark, stages, empty):
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[5].collect())
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_documents_pass_every_stage(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == odd.columns
