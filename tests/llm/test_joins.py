"""Operators 2, 3 and 10 against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimledger.llm import decontaminate, embeddings, ngram_join, shingles
from claimledger.llm.components import components, local_labels

from .conftest import words


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- components

@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    place = {x: i for i, x in enumerate(nodes)}
    want = groups(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    assert got == {x: nodes[want[i]] for i, x in enumerate(nodes)}


def test_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_local_labels(edges):
    a, b = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
    assert local_labels(31, a, b).tolist() == groups(31, edges)


# ---------------------------------------------------------------- n-gram join

def shingle_set(text, k):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAB \n\t\x85é\x00"), max_size=30), max_size=6), st.integers(1, 4))
def test_shingle_sets(texts, k):
    found = shingles.sets(pa.array(texts, pa.string()), k)
    want = [shingle_set(t, k) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(want[i] & want[j])


def test_words_longer_than_a_chunk(monkeypatch):
    texts = ["a" * 300 + " b " + "c" * 50, "c" * 50 + " " + "a" * 300]
    want = shingles.sets(pa.array(texts), 1)
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert [s.tolist() for s in shingles.sets(pa.array(texts), 1)] == [s.tolist() for s in want]
    assert sorted(set(want[0]) & set(want[1])) == want[1].tolist()


def near_copies(seed, n_base=6, n_copies=10, length=140):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)]
    boiler = " ".join(rng.choice(vocabulary) for _ in range(40))
    out = []
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, length))]
        for _ in range(n_copies):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w) + (" " + boiler if rng.random() < 0.4 else ""))
    return out


@pytest.mark.parametrize("k,num,tile", [(3, 90, 1 << 18), (5, 80, 1 << 18), (2, 70, 200)])
def test_classes_against_brute_force(spark, odd, monkeypatch, k, num, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)  # small tiles: bands, chunks and cross tiles
    texts = [(r.doc_id, r.text) for r in odd.collect()] + [(1000 + i, t) for i, t in enumerate(near_copies(k))]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, key string, n long").repartition(3)
    got = sorted(ngram_join.classes(docs, k, num, 100).collect(), key=str)
    sets = [shingle_set(t, k) for _, t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
              and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert len(linked) > 30
    same_id = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i][0] is not None and texts[i][0] == texts[j][0]]
    label = groups(len(texts), linked + same_id)
    least = {}
    for (doc_id, _), c in zip(texts, label):
        if doc_id is not None:
            least[c] = min(doc_id, least.get(c, doc_id))
    want = sorted([(doc_id, len(s), least.get(c) if s else doc_id) for (doc_id, _), s, c in zip(texts, sets, label)], key=str)
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("k,num,tile", [(3, 90, 1 << 18), (2, 70, 200)])
def test_links_against_brute_force(spark, odd, monkeypatch, k, num, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    texts = [(r.doc_id, r.text) for r in odd.collect()] + [(1000 + i, t) for i, t in enumerate(near_copies(k))]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, copies string, n_links long")
    counted = ngram_join.classes(docs.repartition(3), k, num, 100, count_links=True)
    sets = [shingle_set(t, k) for _, t in texts]
    want = [(d, len(s), sum(j != i and bool(s) and bool(x) and 100 * len(s & x) >= num * len(s | x)
                            for j, x in enumerate(sets))) for i, ((d, _), s) in enumerate(zip(texts, sets))]
    rows = counted.collect()
    assert sorted([(r.doc_id, r.n_shingles, r.n_links) for r in rows], key=str) == sorted(want, key=str)
    assert max(n for *_, n in want) > 3 and sum(n for *_, n in want) > len(want)
    plain = ngram_join.classes(docs, k, num, 100).collect()
    assert sorted([tuple(r)[:3] for r in rows], key=str) == sorted([tuple(r) for r in plain], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_divide_skip_finds_all(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(1, 1 << 60, 60, dtype=np.uint64)
    found = [np.unique(rng.choice(pool, rng.integers(5, 50))) for _ in range(40)]
    index = ngram_join.Index(found)
    for s in found:
        for t in (1, 3, len(s) // 2 + 1, len(s)):
            places, overlap = index.search(s, t, np.ones(40, bool))
            want = {i: len(np.intersect1d(s, x)) for i, x in enumerate(found)}
            assert dict(zip(places.tolist(), overlap.tolist())) == {i: n for i, n in want.items() if n >= t}


def test_first_of_class(spark, odd, empty):
    kept = ngram_join.first_of_class(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 9, 10, None], key=str)
    twice = odd.where("doc_id = 6").unionAll(odd.where("doc_id = 6"))
    assert ngram_join.first_of_class(twice).count() == 1
    assert ngram_join.first_of_class(empty).count() == 0


# ---------------------------------------------------------------- decontamination

def levenshtein_part(item, text):
    """Smallest edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(1, 4), min_size=1, max_size=15))
def test_edit_distances(item, text):
    item, text = np.array(item, np.uint64), np.array(text, np.uint64)
    row = decontaminate.edit_rows(item, text[None, :])[0]
    assert row.min() == levenshtein_part(item, text)
    at = decontaminate.first_word(item, text, row)
    assert decontaminate.edit_rows(item, text[None, at:], anchored=True)[0].min() == row.min()


def test_recall_meets_the_target():
    rng = np.random.default_rng(0)
    items = [rng.integers(1, 1 << 60, rng.integers(15, 60), dtype=np.uint64) for _ in range(150)]
    assert decontaminate.recall(items, 0) == 1
    assert decontaminate.recall(items, 0.05) >= 0.95
    assert decontaminate.recall(items, 0.1) >= 0.9


@pytest.mark.parametrize("length", [15, 59, 100, 200, 400, 1000])
def test_recall_of_items_edited_in_one_part(length):
    rng = np.random.default_rng(length)
    items = [rng.integers(1, 1 << 60, length, dtype=np.uint64) for _ in range(40)]
    for part in (None, "head", "middle", "tail", "dropped"):
        assert decontaminate.recall(items, 0.15, part=part) >= 0.95, part


def test_items_edited_in_one_part_are_found(spark):
    rows, bench, want = [], [], set()
    for i, length in enumerate((40, 59, 91, 200, 400)):
        item, most = [f"i{i}w{j}" for j in range(length)], int(decontaminate.EDITS * length)
        new = [f"x{j}" for j in range(most)]
        middle = (length - most) // 2
        bench.append((i, " ".join(item)))
        for k, words in enumerate([item, new + item[most:], item[most:], item[:middle] + item[middle + most:],
                                   item[:middle] + new + item[middle:], item[:-most] + new, new[:-1] + item[most - 1:-1],
                                   item + new + item[:-1]]):
            rows.append((10 * i + k, f"some text {k} before " + " ".join(words) + " and some text behind it"))
            want.add((10 * i + k, i, 0 if k in (0, 7) else most))
        rows.append((10 * i + 8, " ".join(["far"] * (most + 1) + item[most + 1:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and len(got) == len(want)


def test_contamination(spark, odd, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 5, 7, 8, 12, 20, 35, 60, 200)]
    rows, want = [], set()
    for i, item in enumerate(items):
        for before in range(9):
            filler = [word().upper() + "!" for _ in range(before)], [word() for _ in range(rng.randrange(0, 5))]
            doc_id = 100 * (i + 1) + before
            rows.append((doc_id, " ".join(filler[0]) + " " + ", ".join(item).upper() + ". " + " ".join(filler[1])))
            want.add((doc_id, i))
    rows.append((5000, " ".join(items[8][:10] + ["xx"] + items[8][10:])))
    want.add((5000, 8))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (None, "a b")],
                                  "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert want <= found and len(got) == len(found)
    texts = {d: [w.lower() for w in t.replace("!", " ").replace(",", " ").replace(".", " ").split()] for d, t in rows}
    for r in got:  # exact: nothing beyond the distance, and the distances are right
        if r.item_id < 9:
            assert r.edits == levenshtein_part(items[r.item_id], texts[r.doc_id]) <= 0.15 * len(items[r.item_id])
    place = {r.doc_id: r.at for r in got if r.item_id == 9}
    assert all(dict(rows)[d][at:].lower().startswith(items[9][0]) for d, at in place.items() if 1000 <= d < 1009)
    kept = decontaminate.clean(odd, bench.where("item_id > 5"))
    assert kept.count() == odd.count() and kept.columns == odd.columns
    assert decontaminate.clean(docs, bench).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).count() == 0


def test_a_benchmark_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 60)
    items = [" ".join(f"i{k}w{j}" for j in range(10)) for k in range(6)]
    docs = spark.createDataFrame([(k, f"some words {t} and more") for k, t in enumerate(items)] + [(99, "clean text")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(list(decontaminate.passes(bench))) > 2
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == {(k, k) for k in range(6)}
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [99]


# ---------------------------------------------------------------- embeddings

def vectors(seed, dims, n=120):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // 10):
        base = rng.normal(size=dims)
        out += [base * rng.uniform(0.5, 2)] + [base + rng.normal(size=dims) * rng.choice([0.05, 0.2, 0.33]) for _ in range(9)]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("dims,tile", [(64, 16384), (48, 16), (3, 16384), (1, 16384)])
def test_embeddings_against_brute_force(spark, monkeypatch, dims, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = list(enumerate(vectors(dims, dims)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, [0.0] * dims), (503, None), (504, []), (505, [math.nan] * dims),
             (506, [None] * dims), (507, [math.inf] + [1.0] * (dims - 1)), (508, [1.0] * (dims + 2)), (508, [1.0] * (dims + 2)),
             (None, rows[3][1]), (509, [1e30] * (dims + 2))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n_links int, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    good = [(i, np.array(v)) for i, v in dict(rows).items()
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    linked = [(a, b) for a in range(len(good)) for b in range(a) if len(good[a][1]) == len(good[b][1])
              and good[a][1] @ good[b][1] >= 0.95 * np.linalg.norm(good[a][1]) * np.linalg.norm(good[b][1])]
    label = groups(len(good), linked)
    least = {}
    for (i, _), c in zip(good, label):
        least[c] = min(i, least.get(c, i))
    want = {i: (0, i, True) for i, _ in rows if i is not None} | {None: (0, None, False)}
    for k, (i, _) in enumerate(good):
        want[i] = (sum(k in e for e in linked), least[label[k]], i == least[label[k]])
    assert got == want


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
