"""Operator 13: spelling variants by a trie of letter counts.

A word's frequency vector counts its letters by GROUPS letter groups.  One
inserted letter raises one count by one, one deleted letter lowers one, and
one replaced letter does both (or neither, within a group).  So the words
near a word are found by a walk down a trie of successive counts that may
spend a surplus of one and a deficit of one; what the walk reaches is
verified letter by letter.

1. Documents become words with their numbers of occurrences (partial counts
   in the task, one shuffle of distinct words).
2. The trie's levels stand in order of falling variance of the counts, and
   the trie is cut at the depth from which every branch is small enough for
   a task: the smallest depth of DEPTHS whose largest branch has at most
   MIN_BRANCH words or a half of a partition's even share (MAX_BRANCH at
   most).  At full depth a branch is one vector; there, what is larger is cut
   into chunks that meet in pairs, so no branch is too large for a task.
3. A word lives in its branch and visits the branches that it reaches by
   spending above the cut: a pair is searched from one side only, so a word
   goes to one count more, and to one more before one less.  That is
   1 + k + k(k - 1)/2 places at depth k, whatever the words are.
4. A task builds its branch's trie and goes down depth first, with all words
   that are still within budget at once; below LEAF words it compares the
   rest of the vectors and verifies.  A task returns per word how many near
   words it has found and the best of them, not pairs.

Defined cases: null and empty texts have no words; very long texts and words
count whole (words of more than WIDE letters are verified one by one);
repeated rows count again; a null doc_id is hashed as empty text; ties go to
the smallest word in code-point order; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import lean, materialize, parts, release, table, text_slices

#: The contract's letters, shortest word, fewest occurrences, one changed run in EVERY, a form's weight.
LETTERS, SHORTEST, FEWEST, EVERY, WEIGHT = "A-Za-zÀ-ÿ", 5, 3, 97, 2
RUN = re.compile(f"[{LETTERS}]{{{SHORTEST},}}+")
#: A letter's group is its code point modulo GROUPS.
GROUPS = 16
DEPTHS = (2, 3, 4, 5, 6, 8, 10, 12, GROUPS)
MIN_BRANCH, MAX_BRANCH, LEAF = 2048, 1 << 16, 24
#: Letters of words that are verified as rows of a matrix; pairs verified at a time; counts kept by a task.
WIDE, PAIRS, HELD = 32, 1 << 17, 1 << 18


def changed(run: str, prefix: int) -> str:
    """A lower-cased run as the contract counts it: one in EVERY loses a letter."""
    h = zlib.crc32(run.encode(), prefix)
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def occurrences(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> (word, n), every word of at least FEWEST occurrences once."""
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text:
                        continue
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    # bytes.lower changes A-Z alone
                    for w, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                        w = changed(w, prefix)
                        if len(w) >= SHORTEST:
                            held[w] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST))


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts by group, a row per word."""
    raw = "".join(words).encode("latin-1")  # the contract's letters are below 256
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(owner * GROUPS + np.frombuffer(raw, np.uint8) % GROUPS, minlength=len(words) * GROUPS)
    return flat.reshape(-1, GROUPS).astype(np.int32)


def levels(words: DataFrame) -> list[int]:
    """Groups in order of falling variance of their counts (ties: the lower group)."""
    schema = pa.schema([("g", pa.int32()), ("n", pa.int64()), ("s", pa.int64()), ("q", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for b in batches:
            v = vectors(b.column("word").to_pylist()).astype(np.int64)
            n, s, q = n + len(v), s + v.sum(axis=0), q + (v * v).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS, dtype=np.int32)), pa.array([n] * GROUPS, pa.int64()),
                                          pa.array(s), pa.array(q)], schema=schema)

    rows = (words.select("word").mapInArrow(run, "g int, n long, s long, q long").groupBy("g")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect())
    spread = {r["g"]: r["n"] * r["q"] - r["s"] ** 2 for r in rows}
    return sorted(range(GROUPS), key=lambda g: (-spread.get(g, 0), g))


def _branch(v: np.ndarray) -> list[bytes]:
    """The key of each row's counts: 32 bits a level."""
    raw, width = np.ascontiguousarray(v, "<u4").tobytes(), v.shape[1] * 4
    return [raw[i:i + width] for i in range(0, len(raw), width)] if width else [b""] * len(v)


def depth(words: DataFrame, order: list[int], total: int) -> tuple[int, int]:
    """(depth of the cut, words of the largest branch there)."""
    enough = min(MAX_BRANCH, max(MIN_BRANCH, total // (2 * parts(words.sparkSession))))
    for k in DEPTHS:
        def run(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = Counter(_branch(vectors(b.column("word").to_pylist())[:, order[:k]]))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                                 names=["branch", "n"])

        largest = (words.select("word").mapInArrow(run, "branch binary, n long").groupBy("branch")
                   .agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]) or 0
        if largest <= enough:
            break
    return k, largest


PLACED = "branch binary, chunk int, home boolean, up boolean, down boolean, word string, n long"
_PLACED = pa.schema([("branch", pa.binary()), ("chunk", pa.int32()), ("home", pa.bool_()), ("up", pa.bool_()),
                     ("down", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])


def place(words: DataFrame, order: list[int], k: int, largest: int) -> DataFrame:
    """Words at their branches: at home, and as visitors that have spent their surplus (up) or deficit (down)."""
    chunks = max(1, -(-largest // MAX_BRANCH)) if k == GROUPS else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column("word"), b.column("n")
            v = vectors(words.to_pylist())[:, order[:k]]
            own = np.array([zlib.crc32(w.encode()) % chunks for w in words.to_pylist()], np.int32)

            def rows(pick, v, chunk, home, up, down):
                m = len(pick)
                at = pa.array(pick)
                return pa.RecordBatch.from_arrays(
                    [pa.array(_branch(v), pa.binary()), pa.array(chunk, pa.int32()), pa.array([home] * m, pa.bool_()),
                     pa.array([up] * m, pa.bool_()), pa.array([down] * m, pa.bool_()), words.take(at), n.take(at)], schema=_PLACED)

            every = np.arange(len(v))
            yield rows(every, v, own, True, False, False)
            for chunk in range(1, chunks):  # pairs of two chunks meet in the higher one
                low = every[own < chunk]
                if len(low):
                    yield rows(low, v[low], np.full(len(low), chunk, np.int32), False, False, False)
            for i in range(k):
                more = v.copy()
                more[:, i] += 1
                targets = [(every, more, True, False)]
                for j in range(i + 1, k):
                    some = every[v[:, j] > 0]
                    both = more[some].copy()
                    both[:, j] -= 1
                    targets.append((some, both, True, True))
                for pick, to, up, down in targets:
                    for chunk in range(chunks if len(pick) else 0):
                        yield rows(pick, to, np.full(len(pick), chunk, np.int32), False, up, down)

    return words.select("word", "n").mapInArrow(run, PLACED)


def walk(v: np.ndarray, hosts: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, host) pairs within budget: every row of ``v`` goes down the
    trie of the ``hosts`` among them, depth first, all rows that are still
    within budget together."""
    stack = [(0, hosts, np.arange(len(v)), up, down)]
    while stack:
        level, hosts, rows, up, down = stack.pop()
        if len(hosts) <= LEAF or level == v.shape[1]:
            step = max(1, PAIRS // max(1, len(hosts)))
            for at in range(0, len(rows), step):
                r = rows[at:at + step]
                # counts of the host less those of the row, over the levels that are left
                gap = v[hosts, level:][None, :, :] - v[r, level:][:, None, :]
                more, less = np.maximum(gap, 0).sum(axis=2), np.maximum(-gap, 0).sum(axis=2)
                i, j = np.nonzero((more <= 1 - up[at:at + step, None]) & (less <= 1 - down[at:at + step, None]))
                if len(i):
                    yield r[i], hosts[j]
            continue
        counts = v[hosts, level]
        own = v[rows, level]
        for c in np.unique(counts):
            gap = c - own
            alive = (gap == 0) | ((gap == 1) & (up == 0)) | ((gap == -1) & (down == 0))
            if alive.any():
                g = gap[alive]
                stack.append((level + 1, hosts[counts == c], rows[alive], up[alive] + (g == 1), down[alive] + (g == -1)))


def one_apart(a: str, b: str) -> bool:
    """Exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class Words:
    """Words as rows of letters, from the left and from the right."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        raw = [w.encode("latin-1")[:WIDE] for w in words]
        back = [w[::-1].encode("latin-1")[:WIDE] for w in words]
        self.left, self.right = (np.frombuffer(b"".join(w.ljust(WIDE, b"\0") for w in x), np.uint8).reshape(-1, WIDE)
                                 for x in (raw, back))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are one letter apart."""
        si, sj = self.size[i], self.size[j]
        low, high = np.minimum(si, sj), np.maximum(si, sj)
        out = (high - low <= 1) & (high <= WIDE)
        for at in range(0, len(i), PAIRS):
            s = slice(at, at + PAIRS)
            same = [(m[i[s]] != m[j[s]]) for m in (self.left, self.right)]
            ahead, behind = (np.minimum(np.where(x.any(axis=1), x.argmax(axis=1), WIDE), low[s]) for x in same)
            out[s] &= (ahead + behind >= high[s] - 1) & ((ahead < low[s]) | (low[s] < high[s]))
        for p in np.flatnonzero((high > WIDE) & (high - low <= 1)):
            out[p] = one_apart(self.words[i[p]], self.words[j[p]])
        return out


def search(placed: DataFrame, order: list[int], k: int) -> DataFrame:
    """(word, n_near, best): near words found in each branch, and the best as (-n, word)."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        home = rows.column("home").to_numpy()
        hosts = np.flatnonzero(home)
        v = vectors(words)[:, order[k:]]
        up, down = (rows.column(c).to_numpy().astype(np.int8) for c in ("up", "down"))
        known = Words(words)
        # words by (falling n, word): the smallest place is the best form
        by = sorted(range(len(words)), key=lambda r: (-n[r], words[r]))
        rank = np.empty(len(words), np.int64)
        rank[by] = np.arange(len(words))
        count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
        for i, j in walk(v, hosts, up, down):
            once = ~home[i] | (i < j)  # pairs at home are met from both sides
            i, j = i[once], j[once]
            ok = known.near(i, j)
            i, j = i[ok], j[ok]
            count += np.bincount(i, minlength=len(words)) + np.bincount(j, minlength=len(words))
            np.minimum.at(best, i, rank[j])
            np.minimum.at(best, j, rank[i])
        some = np.flatnonzero(count)
        top = np.array(by, np.int64)[best[some]] if len(some) else some
        return pa.RecordBatch.from_arrays([pa.array([words[r] for r in some], pa.string()), pa.array(count[some]),
                                           pa.array(n[top]), pa.array([words[r] for r in top], pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            return [solve(t)] if t.column("home").to_numpy().any() else []

        for b in batches:
            keys = list(zip(b.column("branch").to_pylist(), b.column("chunk").to_pylist()))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if keys[s] != at and held:
                    yield from done()
                    held = []
                at = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from done()

    return (placed.repartition(parts(placed.sparkSession), "branch", "chunk").sortWithinPartitions("branch", "chunk")
            .mapInArrow(run, "word string, n_near long, best_n long, best string"))


def near_words(words: DataFrame) -> DataFrame:
    """``words`` (word, n; stored) -> with n_near, form and form_n."""
    total = words.count()
    found = "word string, n_near long, best_n long, best string"
    if total:
        order = levels(words)
        k, largest = depth(words, order, total)
        near = search(place(words, order, k, largest), order, k)
    else:
        near = words.sparkSession.createDataFrame([], found)
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                    F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form"))).alias("b"))
    out = words.join(near, "word", "left")
    heavy = -F.col("b.m") >= WEIGHT * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      F.when(heavy, F.col("b.form")).alias("form"), F.when(heavy, -F.col("b.m")).alias("form_n"))


def roots(words: DataFrame) -> DataFrame:
    """``words`` (word, form, ...) with root, the end of the forms: every
    round follows twice as many, over the words that have a form alone."""
    chain = materialize(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(chain.join(ahead, "root", "left")
                             .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        chain = longer.select("word", "root")
        if longer.where("went").isEmpty():
            break
    return words.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> word, n, n_near, form, form_n, root."""
    words = materialize(occurrences(docs))
    return roots(materialize(near_words(words)))


def q_spelling(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "word", "form", "root", "n", "n_near", "form_n")


SQL = rf"""
WITH RECURSIVE crc AS (  -- the usual table of crc32, one entry per byte
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) WHERE length(r) >= 5
  GROUP BY 1, 2),
hashed AS (
  SELECT r, k, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id || ':' || r, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]::BIGINT[] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
w AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS c
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.c = b.c AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN w b ON a.c = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN w b ON a.c = b.word),
best AS (SELECT a AS word, count(*) AS n_near, min({{'m': -n, 'f': b}}) AS b FROM pairs GROUP BY a),
f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * n THEN b.f END AS form, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS step FROM f
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) USING (word)"""
