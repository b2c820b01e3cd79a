"""Operator 3: benchmark decontamination by CGK embedding and bit sampling.

Texts are sequences of words (runs of ASCII letters and digits and of all
characters beyond ASCII, A-Z folded).  The CGK embedding walks over a
sequence: at step j it writes the current word and moves on if a random bit
of (j, word) is set.  Two sequences with few edits fall out of step at an
edit and into step again soon, so their embeddings differ in few places:
edit distance becomes Hamming distance.  Bit sampling then is an LSH: the
words written at a few random steps are a key, and REPEATS independent
walks make a match of one key likely (``recall`` measures it).

Lengths of items form classes, and every walk over a document serves all
classes, each sampling steps within its own length, at most WALK of them.
A walk moves one word every two steps, so its keys see a segment of the
item; items are indexed by overlapping segments from their first to their
last word, whatever their length, so edits in one part leave the keys of
the others.  Windows start at every STRIDE-th word; a segment is indexed at
as many offsets, so an unchanged copy at any place meets a key in every
walk, and for items too short for that windows start at every word.

Candidates are verified exactly: the smallest edit distance, in words, of
the item to any part of the document around the window must be at most
EDITS of the item's words.

The work is one pass over the texts without a shuffle.  The items of one
pass are bounded (PASS_BYTES); a larger benchmark takes several passes.

Defined cases: null, empty and wordless texts contain no item; items
without words are nowhere; equal items are found separately; a document
that holds an item several times has one row, with the fewest edits, then
the first place; repeated documents have rows each; empty tables give an
empty result; extra columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm import shingles
from claimledger.llm.common import lean, release, table, text_slices

EDITS, REPEATS, SAMPLES, STRIDE = 0.15, 8, 4, 4
#: Longest walk, and items under this many words, for which windows start at every word.
WALK, SHORT = 96, 2 * STRIDE
PASS_BYTES = 16 << 20
CLASSES = np.unique(np.concatenate([[1, 2, 3, 4, 6], (8 * 1.5 ** np.arange(40)).astype(np.int64)]))


def _salts(repeat: int) -> np.ndarray:
    return np.random.default_rng(1000 + repeat).integers(0, 1 << 63, (WALK + 63) // 64, dtype=np.uint64)


class Walk:
    """One repeat of the embedding over words with an end mark (0) after
    each sequence; the walk can't leave a sequence."""

    def __init__(self, words: np.ndarray, repeat: int):
        self.words = words
        self.bits = [np.where(words == 0, np.uint64(0), shingles.mix(words + s)) for s in _salts(repeat)]

    def steps(self, starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Place of every walk at steps 0..n-1."""
        at = starts.astype(np.int32)
        for j in range(n):
            yield at
            at = at + ((self.bits[j >> 6][at] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int32)


class Plan:
    """Sampled steps per repeat and class, for the lengths that items have."""

    def __init__(self, lengths: np.ndarray):
        # classes of which a walk sees a part only are one
        whole = int(np.flatnonzero(1.2 * (CLASSES - STRIDE + 1) >= WALK)[0])
        self.of = np.minimum(np.searchsorted(CLASSES, lengths, "right") - 1, whole)
        self.classes = [int(c) for c in np.unique(self.of)]
        self.samples: dict[tuple[int, int], np.ndarray] = {}
        for r in range(REPEATS):
            rng = np.random.default_rng(2000 + r)
            order = rng.random(WALK)
            for c in self.classes:
                self.samples[r, c] = np.sort(np.argsort(order[:self.reach(c)])[:SAMPLES])

    def stride(self, c: int) -> int:
        return 1 if CLASSES[c] < SHORT else STRIDE

    def reach(self, c: int) -> int:
        return max(1, min(WALK, int(1.2 * (CLASSES[c] - self.stride(c) + 1))))

    def offsets(self, c: int, length: int) -> np.ndarray:
        """Where an item's segments start: overlapping ones up to its last word."""
        stride, cover = self.stride(c), -(-3 * self.reach(c) // 5)
        last = max(0, length - cover - stride + 1)
        first = np.append(np.arange(0, last, max(stride, cover // 2)), last)
        return np.unique(first[:, None] + np.arange(stride))

    def keys(self, walk: Walk, repeat: int, starts: np.ndarray, classes: list[int]) -> dict[int, np.ndarray]:
        """Per class the key of every start."""
        wanted = {c: self.samples[repeat, c] for c in classes}
        out = {c: np.zeros(len(starts), np.uint64) for c in classes}
        for j, at in enumerate(walk.steps(starts, 1 + max(int(s[-1]) for s in wanted.values()))):
            written = None
            for c, steps in wanted.items():
                k = np.searchsorted(steps, j)
                if k < len(steps) and steps[k] == j:
                    written = walk.words[at] if written is None else written
                    out[c] += written * shingles.PLACE[k]
        return {c: shingles.mix(k) for c, k in out.items()}


class Benchmark:
    """Items and their keys; built on the driver, sent to the tasks."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, at = shingles.flat(pa.array(texts, pa.string()))
        h, starts, _ = shingles.words(data, at, shingles.BARE)
        h = np.where(h == 0, np.uint64(1), h)
        doc = np.searchsorted(at, starts, "right") - 1
        count = np.bincount(doc, minlength=len(texts))
        keep = np.flatnonzero(count)
        self.ids = np.array(ids, dtype=np.int64)[keep]
        parts = np.split(h, np.cumsum(count)[:-1]) if len(texts) else []
        self.items = [parts[i] for i in keep]
        self.lengths = np.array([len(x) for x in self.items], dtype=np.int64)
        if not len(self.items):
            return
        self.plan = Plan(self.lengths)
        words = np.concatenate([np.append(x, np.uint64(0)) for x in self.items])
        begin = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.index: dict[tuple[int, int], tuple] = {}
        for r in range(REPEATS):
            walk = Walk(words, r)
            for c in self.plan.classes:
                own = np.flatnonzero(self.plan.of == c)
                shifts = [self.plan.offsets(c, int(self.lengths[i])) for i in own]
                item, offset = np.repeat(own, [len(x) for x in shifts]).astype(np.int32), np.concatenate(shifts).astype(np.int32)
                keys = self.plan.keys(walk, r, begin[item] + offset, [c])[c]
                order = np.argsort(keys, kind="stable")
                bits = min(26, max(16, int(len(keys) * 64 - 1).bit_length()))
                shift_bits = np.uint64(64 - bits)
                seen = np.zeros(1 << bits, bool)
                seen[keys >> shift_bits] = True
                self.index[r, c] = (keys[order], item[order], offset[order], seen, shift_bits)

    def candidates(self, words: np.ndarray, starts: np.ndarray, stride: int, classes: list[int]):
        """(start, offset, item) with a common key."""
        out = []
        for r in range(REPEATS):
            walk = Walk(words, r)
            for k in range(0, len(starts), 1 << 18):
                some = starts[k:k + (1 << 18)]
                for c, keys in self.plan.keys(walk, r, some, classes).items():
                    known, item, offset, seen, shift = self.index[r, c]
                    hit = np.flatnonzero(seen[keys >> shift])
                    lo = np.searchsorted(known, keys[hit], "left")
                    n = np.searchsorted(known, keys[hit], "right") - lo
                    entry = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
                    out.append(np.stack([np.repeat(some[hit], n), offset[entry], item[entry]], axis=1))
        return np.concatenate(out)


def edit_rows(item: np.ndarray, around: np.ndarray, anchored: bool = False) -> np.ndarray:
    """Per row of ``around`` and place in it, the smallest edit distance of
    ``item`` to a part that ends there (and starts anywhere, or at 0)."""
    n, width = around.shape
    ramp = np.arange(width + 1, dtype=np.int32)
    row = np.tile(ramp, (n, 1)) if anchored else np.zeros((n, width + 1), np.int32)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (around != w), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row


def first_word(item: np.ndarray, around: np.ndarray, row: np.ndarray) -> int:
    """Where in ``around`` the nearest part starts, from its last ``row``."""
    end = int(row.argmin())
    back = edit_rows(item[::-1], around[None, :end][:, ::-1], anchored=True)[0]
    return end - int(np.flatnonzero(back == row.min())[0])


def find(bench: Benchmark, column) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> (item, edits, first byte of the place) of the items in a text column."""
    if not len(bench.items):
        return {}
    data, at = shingles.flat(column)
    h, byte, _ = shingles.words(data, at, shingles.BARE)
    if not len(h):
        return {}
    h = np.where(h == 0, np.uint64(1), h)
    doc = np.searchsorted(at, byte, "right") - 1
    # an end mark after each text's words
    place = np.arange(len(h)) + doc
    words = np.zeros(len(h) + len(at) - 1, np.uint64)
    words[place] = h
    count = np.bincount(doc, minlength=len(at) - 1)
    begin = np.cumsum(count + 1) - count - 1
    groups: dict[int, list[int]] = {}
    for c in bench.plan.classes:
        groups.setdefault(bench.plan.stride(c), []).append(c)
    owner = np.repeat(np.arange(len(count)), count + 1)
    met = np.concatenate([bench.candidates(words, place[(place - begin[doc]) % stride == 0], stride, classes)
                          for stride, classes in groups.items()])
    # by item, document and the place where the item would start: near ones, as edits shift its
    # segments, are one
    near = (EDITS * bench.lengths[met[:, 2]]).astype(np.int64) + STRIDE
    met = np.unique(np.stack([met[:, 2], owner[met[:, 0]], (met[:, 0] - met[:, 1]) // near * near], axis=1), axis=0)
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for item in np.unique(met[:, 0]):
        m = int(bench.lengths[item])
        most = int(EDITS * m)
        own = met[met[:, 0] == item, 1:]
        reach = np.arange(-most - STRIDE, m + 2 * most + 2 * STRIDE)[None, :]
        step = max(1, (1 << 20) // reach.size)
        for k in range(0, len(own), step):
            row, at_word = own[k:k + step, 0], own[k:k + step, 1]
            span = at_word[:, None] + reach
            inside = (span >= begin[row][:, None]) & (span < (begin + count)[row][:, None])
            around = np.where(inside, words[np.clip(span, 0, len(words) - 1)], np.uint64(0))
            ends = edit_rows(bench.items[item], around)
            d = ends.min(axis=1)
            for g in np.flatnonzero(d <= most):
                p = int(span[g, 0]) + first_word(bench.items[item], around[g], ends[g])
                best = found.setdefault(int(row[g]), {}).get(int(item))
                if best is None or (int(d[g]), p) < best:
                    found[int(row[g])][int(item)] = (int(d[g]), p)
    out = {}
    for row, got in found.items():
        out[row] = []
        for item, (e, p) in sorted(got.items()):
            first = min(max(p, int(begin[row])), int(begin[row] + count[row]) - 1)
            out[row].append((item, e, int(byte[first - row] - at[row])))
    return out


def passes(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The items in portions of bounded size."""
    lean(benchmark.sparkSession)
    b = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PASS_BYTES)
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, at) for every item in a document; ``at`` is
    the code point where the nearest part starts."""
    names = ["doc_id", "item_id", "edits", "at"]

    def search(bench: Benchmark) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            bench = shared.value
            for b in batches:
                for part in text_slices(b, "text", 2 << 20):
                    found = find(bench, part.column("text"))
                    if found:
                        ids, texts = part.column("doc_id"), part.column("text")
                        rows = [(ids[r].as_py(), int(bench.ids[i]), e, len(texts[r].as_py().encode()[:p].decode()))
                                for r, got in sorted(found.items()) for i, e, p in got]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits long, at long")

    out = None
    for bench in passes(benchmark):
        out = search(bench) if out is None else out.unionAll(search(bench))
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long, at long")
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    for bench in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            for b in batches:
                for part in text_slices(b, "text", 2 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[list(find(shared.value, part.column("text")))] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def recall(items: list[np.ndarray], rate: float, seed: int = 0, part: str | None = None) -> float:
    """Share of items with a common key after editing ``rate`` of their words
    (replaced, dropped or inserted in turn), at a random place.  The edits
    are anywhere, or in the ``part`` head, middle or tail, as long as they
    are many; in the part "dropped" the item loses its first words."""
    rng = np.random.default_rng(seed)
    hits = 0
    for x in items:
        y = x.tolist()
        edits = int(round(rate * len(x))) if part is None else int(rate * len(x))
        base = {"middle": (len(x) - edits) // 2, "tail": len(x) - edits}.get(part, 0)
        if part == "dropped":
            y, edits = y[edits:], 0
        for k in range(edits):
            i = int(rng.integers(len(y))) if part is None else min(base + int(rng.integers(edits)), len(y) - 1)
            new = int(rng.integers(1, 1 << 62))
            y[i:i + (k % 3 < 2)] = [new] if k % 3 != 1 else []
        before = rng.integers(1, 1 << 62, int(rng.integers(0, 30)), dtype=np.uint64)
        after = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
        text = np.concatenate([before, np.array(y, np.uint64), after, [np.uint64(0)]])
        plan = Plan(np.array([len(x)]))
        c = plan.classes[0]
        own = np.append(x, np.uint64(0))
        starts = np.arange(0, len(text) - 1, plan.stride(c))
        hits += any(np.isin(plan.keys(Walk(text, r), r, starts, [c])[c],
                            plan.keys(Walk(own, r), r, plan.offsets(c, len(x)), [c])[c]).any() for r in range(REPEATS))
    return hits / max(1, len(items))


def q_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                         table(spark, sf_dir, "benchmark"))
