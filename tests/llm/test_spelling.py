"""Operator 13 against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimledger.llm import spelling as sp
from claimledger.llm.common import materialize, table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(n):
    near = {w: [] for w in n}
    ws = sorted(n)
    for i, a in enumerate(ws):
        for b in ws[i + 1:]:
            if abs(len(a) - len(b)) <= 1 and distance(a, b) == 1:
                near[a].append(b)
                near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_small_tables_equal_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(40)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = sp.variants(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows(got) == brute(counted(texts)) and got.count() > 200


@pytest.mark.parametrize("few", [(1, 4, 3), (1, 2, 2)])
def test_deep_cuts_and_chunks_equal_brute_force(spark, monkeypatch, few):
    """A trie cut at every depth, down to branches of one vector in chunks."""
    monkeypatch.setattr(sp, "MIN_BRANCH", few[0])
    monkeypatch.setattr(sp, "MAX_BRANCH", few[1])
    monkeypatch.setattr(sp, "LEAF", few[2])
    rng = random.Random(3)
    base = ["".join(rng.choices("abqrÀéÿ", k=rng.randint(5, 7))) for _ in range(40)]
    words = {w: rng.randint(3, 60) for b in base for w in [
        b, b[::-1], "".join(sorted(b)), b[:2] + rng.choice("abr") + b[3:], b[:3] + "q" + b[3:], b[1:] + b[0]] if len(w) >= 5}
    words |= {b[:-2] + b[-1]: 3 for b in base if len(b) > 5}
    df = materialize(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sp.depth(df, list(range(16)), len(words))[0] == 16
    assert rows(sp.roots(materialize(sp.near_words(df)))) == brute(words)


@given(st.text("abcé", min_size=0, max_size=9), st.text("abcé", min_size=0, max_size=9))
@settings(max_examples=300, deadline=None)
def test_one_letter_apart(a, b):
    want = distance(a, b) == 1
    assert sp.one_apart(a, b) == want
    if a and b:
        assert sp.Words([a, b]).near(np.array([0]), np.array([1]))[0] == want
        long = "x" * 40
        assert sp.Words([long + a, long + b]).near(np.array([1]), np.array([0]))[0] == want


def test_words_at_the_edge_of_the_matrix():
    ws = ["a" * 31, "a" * 32, "a" * 33, "a" * 31 + "b", "b" + "a" * 31, "a" * 34]
    pairs = [(i, j) for i in range(len(ws)) for j in range(len(ws)) if i != j]
    i, j = (np.array(x) for x in zip(*pairs))
    assert sp.Words(ws).near(i, j).tolist() == [distance(ws[a], ws[b]) == 1 for a, b in pairs]


def test_odd_documents(spark, odd, empty):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(sp.variants(odd)) == brute(counted(texts))
    assert sp.variants(empty).collect() == []
    long = "ab" * 30000
    more = [(1, f"{long} {long} {long} {long}x {long}x {long}x"), (1, "x÷y×zzz ÀÀÀÀÀ ààààà " * 3), (2, None), (2, "")]
    got = rows(sp.variants(spark.createDataFrame(more, "doc_id long, text string")))
    n = counted(more)
    assert [(r[0], r[3]) for r in got] == sorted(n.items()) and sum(r[4] for r in got) == 2
