"""Operator 11 against a plain computation with Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimledger.llm import vector_codes as vc
from claimledger.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int, code string, rid long"


def plain(rows, parts=vc.PARTS):
    """(vec_id, code, error) rows and codebooks of (vec_id, vector) rows, one value at a time."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(good[0][1])
    ends = np.cumsum([0] + [len(x) for x in np.array_split(range(dims), parts)])
    cut = [[v[s:e] for s, e in zip(ends, ends[1:])] for _, v in good]
    books = [[c[p] for c in cut[:256]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(4):
        for p in range(parts):
            at = [nearest(c[p], books[p])[1] for c in cut]
            for e in set(at):
                own = [c[p] for c, k in zip(cut, at) if k == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for (i, _), c in zip(good, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def by_key(rows):
    return sorted(rows, key=str)


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.5, (40, 10))
    rows = [(int(i) * 3, (centres[i % 40] + rng.normal(0, 0.1, 10)).tolist(), int(i) % 3 or None, "x", 1) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, books = vc.encode(df)
    want, plain_books = plain([(r[0], r[1]) for r in rows])
    got = vc.with_label_error(got)
    out = got.collect()
    assert by_key((r.vec_id, r.code, r.error) for r in out) == by_key(want)
    assert [b.tolist() for b in books] == plain_books
    label = {r[0]: r[2] for r in rows}
    total = {}
    for i, _, e in want:
        total[label[i]] = total.get(label[i], 0) + e
    assert all(r.label_error == total[label[r.vec_id]] for r in out)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [None, 0.0, 0.0, 0.0], 1),
            (6, [0.5, -0.5, 0.25, 1e300], None), (7, [0.5, -0.5, 0.25, -1e300], None), (7, [0.5, -0.5, 0.25, 1.0], 2),
            (None, [-0.0001, 0.0, 0.0, 0.0], 2), (8, [1.0, 2.0], 2)]
    got, books = vc.encode(spark.createDataFrame([(*r, "c", 5) for r in rows], SCHEMA))
    out = vc.with_label_error(got).collect()
    assert sorted((r.vec_id for r in out), key=str) == [6, 7, 7, None]
    assert all(len(r.code) == 8 and r.error == 0 and r.label_error == 0 for r in out)
    # 4 kept rows: 4 entries, in order of id (null last) and array; large components are held at the limit
    assert books[3].ravel().tolist() == [vc.LIMIT, -vc.LIMIT, 1024, 0] and books[0].ravel().tolist() == [512, 512, 512, -1]


def test_empty_table_and_few_columns(spark):
    got, books = vc.encode(spark.createDataFrame([], SCHEMA))
    assert vc.with_label_error(got).collect() == []
    assert vc.codebooks_sha256(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_ties_go_to_the_lower_entry_and_large_integers_are_exact():
    book = np.array([[0, 0], [2, 0], [1, 1]], np.int64)
    assert vc.nearest(np.array([[1, 0], [1, -1]]), book)[0].tolist() == [0, 0]
    top = vc.LIMIT
    big = np.array([[top, top, top, top], [top - 1, top, top, top]], np.int64)
    place, far = vc.nearest(np.array([[top - 1, top, top, top - 2], [-top] * 4]), big)
    assert place.tolist() == [1, 1] and far.tolist() == [4, 3 * (2 * top) ** 2 + (2 * top - 1) ** 2]


def test_only_changing_parts_are_shuffled(spark):
    """After the first round the shuffle carries the parts that change their entry, and salts split a popular one."""
    rng = np.random.default_rng(1)
    rows = [(i, [0.5] * 8 if i % 3 else rng.normal(0, 0.3, 8).tolist(), 0, "x", 1) for i in range(900)]
    v = spark.createDataFrame(rows, SCHEMA).where("embedding IS NOT NULL").withColumn("rid", F.col("vec_id"))
    books = [np.array([[0, 0], [512, 512], [-300, 100]], np.int64)] * 4
    first = vc.materialize(vc.assign(vc.cut(v, 8), books))
    assert first.where("NOT moves").count() == 0
    owned = vc.materialize(vc.migrate(first))
    popular = owned.where("entry = 1 AND position = 0").count()
    held = owned.where("entry = 1 AND position = 0").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert popular >= 600 and held < popular  # split over owners
    again = vc.materialize(vc.assign(owned, books))
    assert again.where("moves").count() == 0
    moved = [b.copy() for b in books]
    moved[0] = np.array([[0, 0], [512, 512], [-100, -100]], np.int64)
    third = vc.materialize(vc.assign(owned, moved))
    assert 0 < third.where("moves").count() < 300 and third.where("moves AND position > 0").count() == 0


@pytest.mark.parametrize("dims", [1, 3, 6])
def test_lengths_that_do_not_divide(spark, dims):
    rows = [(i, [float(i % 7) / 8 + k for k in range(dims)], 1, "x", 1) for i in range(20)]
    got, _ = vc.encode(spark.createDataFrame(rows, SCHEMA))
    assert by_key((r.vec_id, r.code, r.error) for r in got.collect()) == by_key(plain([(r[0], r[1]) for r in rows])[0])


def test_query_of_whole_table(spark):
    out = vc.q_vector_codes(spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert out.count() == table(spark, "/root/testdata/sf0.001", "embeddings").count()
