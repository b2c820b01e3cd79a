"""Operator 7: toxicity by a linear-chain conditional random field.

Labels are on documents, the field tags tokens.  Token labels come from the
documents: a word, or the first five or four letters of one, is a cue if it
stands in many different contexts of toxic documents and (nearly) never in
clean ones; contexts, not documents, are counted, so that copies of one
text count once.  In toxic documents cues are labelled toxic, all else is
clean.  The field has two states; its features are the cue class of a token
and of its neighbours.  Forward-backward gives each token's marginal
probability; their sum, maximum and density give the document's score by a
logistic regression on the documents' labels; tokens with a marginal of one
half or more are the offending offsets.

A chain is at most CHAIN tokens of a document; a text is scored whole, chain
by chain.

Learning uses a sample of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled
documents (smallest id hashes; a documented bound of the classifier).  The
counts over it and the choice of cues are Spark jobs; the driver gets cues
(at most CUES, those with most contexts of all that pass the ratio test) and
class numbers of the sample's tokens.

Defined cases: null, empty and wordless texts score as a text without any
cue; null labels teach nothing; a document labelled twice counts as toxic if
any label is; without labelled documents of both kinds the score is 0 for
all; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import held_out, lean, materialize, table, text_slices

SAMPLE_TOXIC, SAMPLE_CLEAN = 6000, 12000
CUES, MIN_CONTEXTS, MIN_RATIO = 40_000, 8, 20.0
CHAIN, TRAIN_CHAINS = 64, 12_000
CACHED = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+")


def forms(word: str) -> tuple[str, ...]:
    """A word's features, most general first: a stem that is a cue stands for
    all words that start so, also for unseen ones."""
    return (*[f"{word[:n]}-" for n in (4, 5) if len(word) > n], word)


# ---------------------------------------------------------------- the field

class Field:
    """Two states; per class weights for the token itself and either neighbour."""

    def __init__(self, classes: int):
        self.w = np.zeros((3, classes))
        self.bias = np.zeros(1)
        self.move = np.zeros((2, 2))

    def potentials(self, chains: np.ndarray) -> np.ndarray:
        """Log-potential of state 1 against state 0 per token."""
        before = np.pad(chains, ((0, 0), (1, 0)))[:, :-1]
        after = np.pad(chains, ((0, 0), (0, 1)))[:, 1:]
        return self.w[0][chains] + self.w[1][before] + self.w[2][after] + self.bias[0]

    def run(self, chains: np.ndarray, mask: np.ndarray):
        """Marginals of state 1, pair marginals' sums, log-partition."""
        e = np.exp(np.clip(self.potentials(chains), -30, 30))
        m = np.exp(self.move)
        n, length = chains.shape
        alpha, scale = np.empty((length, n, 2)), np.empty((length, n))
        beta = np.ones((length, n, 2))
        for t in range(length):
            a = np.ones((n, 2)) if t == 0 else alpha[t - 1] @ m
            a = np.stack([a[:, 0], a[:, 1] * e[:, t]], axis=1)
            # padding keeps the last real message
            if t:
                a = np.where(mask[:, t, None], a, alpha[t - 1])
            scale[t] = a.sum(axis=1)
            alpha[t] = a / scale[t][:, None]
        for t in range(length - 2, -1, -1):
            b = beta[t + 1] * np.stack([np.ones(n), e[:, t + 1]], axis=1)
            b = b @ m.T
            b /= b.sum(axis=1, keepdims=True)
            beta[t] = np.where(mask[:, t + 1, None], b, 1.0)
        p = alpha * beta
        p = (p[:, :, 1] / p.sum(axis=2)).T * mask
        return p, alpha, beta, e, m, np.where(mask, np.log(scale).T, 0).sum()

    def fit(self, chains: np.ndarray, mask: np.ndarray, tags: np.ndarray, rounds: int = 60, l2: float = 1e-3) -> None:
        state = [np.zeros_like(x) for x in (self.w, self.bias, self.move) for _ in (0, 1)]
        before = np.pad(chains, ((0, 0), (1, 0)))[:, :-1]
        after = np.pad(chains, ((0, 0), (0, 1)))[:, 1:]
        classes, n = self.w.shape[1], mask.sum()
        pairs = mask[:, 1:]
        seen = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                seen[a, b] = ((tags[:, :-1] == a) & (tags[:, 1:] == b) & pairs).sum()
        for k in range(1, rounds + 1):
            p, alpha, beta, e, m, _ = self.run(chains, mask)
            d = (tags - p) * mask
            grad_w = np.stack([np.bincount(c.ravel(), d.ravel(), classes) for c in (chains, before, after)])
            expected = np.zeros((2, 2))
            for t in range(chains.shape[1] - 1):
                right = beta[t + 1] * np.stack([np.ones(len(e)), e[:, t + 1]], axis=1)
                joint = alpha[t][:, :, None] * m[None] * right[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                expected += (joint * pairs[:, t, None, None]).sum(axis=0)
            grads = [grad_w / n - l2 / len(chains) * self.w, np.array([d.sum() / n]), (seen - expected) / n]
            for i, (x, g) in enumerate(zip((self.w, self.bias, self.move), grads)):
                state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
                state[2 * i + 1] = 0.999 * state[2 * i + 1] + 0.001 * g * g
                x += 0.2 * (state[2 * i] / (1 - 0.9 ** k)) / (np.sqrt(state[2 * i + 1] / (1 - 0.999 ** k)) + 1e-9)

    def marginals(self, chains: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.run(chains, mask)[0]


def cut(classes: np.ndarray, lengths: np.ndarray):
    """Documents' tokens (one after the other) as padded chains: (chains,
    mask, document of each chain)."""
    n = -(-lengths // CHAIN)
    doc = np.repeat(np.arange(len(lengths)), n)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(CHAIN, lengths[doc] - part * CHAIN)
    start = (np.cumsum(lengths) - lengths)[doc] + part * CHAIN
    mask = np.arange(CHAIN)[None, :] < size[:, None]
    at = np.where(mask, start[:, None] + np.arange(CHAIN)[None, :], 0)
    chains = np.where(mask, classes[at] if len(classes) else 0, 0)
    return chains, mask, doc


def summary(field: Field, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features per document, marginal per token).  Chains without any cue
    are alike for their length, so one of each length is run.  What counts
    is by how much marginals exceed those of such a chain: a long text gets
    no score for its length."""
    chains, mask, doc = cut(classes, lengths)
    p = np.zeros(mask.shape)
    plain = ~chains.any(axis=1)
    some = np.flatnonzero(~plain)
    for k in range(0, len(some), 4096):
        own = some[k:k + 4096]
        p[own] = field.marginals(chains[own], mask[own])
    size = mask.sum(axis=1)
    background = field.marginals(np.zeros((CHAIN, CHAIN), np.int64), np.tri(CHAIN, dtype=bool))
    p[plain] = background[size[plain] - 1]
    excess = np.zeros(len(p))
    excess[some] = np.maximum(p[some] - background[size[some] - 1], 0).sum(axis=1)
    total = np.bincount(doc, excess, len(lengths))
    top = np.zeros(len(lengths))
    np.maximum.at(top, doc, p.max(axis=1, initial=0) if len(p) else np.zeros(0))
    return np.stack([top, np.log1p(total), 20 * total / np.maximum(lengths, 1)], axis=1), p[mask]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Weights (bias last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


# ---------------------------------------------------------------- learning

def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the sampled documents; ``labels`` holds learning rows only."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    ids = (known.where("toxic = 1").orderBy(order).limit(SAMPLE_TOXIC)
           .unionAll(known.where("toxic = 0").orderBy(order).limit(SAMPLE_CLEAN)))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN narrow rows
    return docs.join(F.broadcast(ids), "doc_id").select("text", "toxic")


def fold(text: str | None) -> str:
    """Lower case, character by character where it would change the length:
    offsets stay those of the text."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find_cues(sample: DataFrame) -> dict[str, int]:
    """Cue -> class number (from 1), over the sample's tokens.  Contexts,
    occurrences and the ratio test are Spark's; only cues are collected."""
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b, "text", 1 << 20):
                out = set()
                for t in part.column("text").to_pylist():
                    w = ["", *TOKEN.findall(fold(t)), ""]
                    for a, x, z in zip(w, w[1:], w[2:]):
                        out.update((f, f"{a} {z}") for f in forms(x))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["f", "c"])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b, "text", 1 << 20):
                found = (Counter(), Counter())
                for t, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    w = TOKEN.findall(fold(t))
                    own = found[toxic == 1]
                    own[""] += len(w)
                    for x, k in Counter(w).items():
                        for f in forms(x):
                            own[f] += k
                names = list(found[0] | found[1])
                if names:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in found)],
                        names=["f", "zero", "one"])

    counts = materialize(sample.select("text", "toxic").mapInArrow(occurrences, "f string, zero long, one long")
                         .groupBy("f").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")))
    tokens = counts.where("f = ''").first()
    share = ((tokens["zero"] if tokens else 0) + 1) / ((tokens["one"] if tokens else 0) + 1)
    toxic = sample.where("toxic = 1").select("text").mapInArrow(contexts, "f string, c string")
    wide = toxic.distinct().groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_CONTEXTS)
    least = MIN_RATIO * (F.col("zero") + 0.5)
    kept = (wide.join(counts, "f").where((F.col("n") * share >= least) & (F.col("one") * share >= least))
            .orderBy(F.desc("n"), "f").limit(CUES).collect())
    return {r["f"]: i + 1 for i, r in enumerate(kept)}


class _Classes(dict):
    def __init__(self, cues: dict[str, int]):
        super().__init__()
        self.cues = cues

    def __missing__(self, word: str) -> int:
        k = next((self.cues[f] for f in forms(word) if f in self.cues), 0)
        if len(self) >= CACHED:
            self.clear()
        if len(word) <= 40:
            self[word] = k
        return k


def classify(texts: list[str | None], known: _Classes) -> tuple[np.ndarray, np.ndarray]:
    """(class per token, tokens per text)."""
    look, found, lengths = known.__getitem__, [], []
    for t in texts:
        w = TOKEN.findall(fold(t))
        lengths.append(len(w))
        found.extend(map(look, w))
    return np.array(found, dtype=np.int64), np.array(lengths, dtype=np.int64)


class Model:
    def __init__(self, cues: dict[str, int], field: Field, weights: np.ndarray):
        self.cues, self.field, self.weights = cues, field, weights


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    lean(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels))
    cues = find_cues(sample)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Classes(cues)
        for b in batches:
            for part in text_slices(b, "text"):
                classes, lengths = classify(part.column("text").to_pylist(), known)
                parts = np.split(classes.astype("<u2"), np.cumsum(lengths)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in parts], pa.binary()),
                                                  part.column("toxic").cast(pa.int64())], names=["tokens", "toxic"])

    rows = sample.mapInArrow(numbers, "tokens binary, toxic long").toArrow().sort_by([("tokens", "ascending")])
    y = rows["toxic"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    tokens = [np.frombuffer(x, "<u2") for x in rows["tokens"].to_pylist()]
    portions = [slice(k, k + 500) for k in range(0, len(tokens), 500)]

    def numbers_of(part: slice) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(tokens[part]).astype(np.int64), np.array([len(x) for x in tokens[part]])

    # chains with cues teach the weights, as many without the background
    rng, picked = np.random.default_rng(7), {True: [], False: []}
    for part in portions:
        chains, mask, doc = cut(*numbers_of(part))
        cue = chains.any(axis=1)
        for kind in picked:
            own = rng.permutation(np.flatnonzero(cue == kind))[:TRAIN_CHAINS]
            own = own if kind else own[:max(1, TRAIN_CHAINS // len(portions))]
            tags = (chains[own] > 0) & (y[part][doc[own]] == 1)[:, None]
            picked[kind].append((chains[own].astype(np.int32), mask[own], tags))
    taken = []
    for parts in picked.values():
        chains, mask, tags = (np.concatenate(x) for x in zip(*parts))
        own = rng.permutation(len(chains))[:TRAIN_CHAINS // 2]
        taken.append((chains[own], mask[own], tags[own]))
    field = Field(len(cues) + 1)
    field.fit(*(np.concatenate(x) for x in zip(*taken)))
    features = np.concatenate([summary(field, *numbers_of(part))[0] for part in portions])
    return Model(cues, field, logistic(features, y))


# ---------------------------------------------------------------- scoring

def score(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, score and, if asked for, spans:
    (start, end, probability) of the offending tokens, in code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Classes(model.cues if model else {})
        for b in batches:
            for part in text_slices(b, "text"):
                texts = part.column("text").to_pylist()
                found = [[] for _ in texts]
                if model:
                    classes, lengths = classify(texts, known)
                    x, p = summary(model.field, classes, lengths)
                    s = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
                    ends = np.cumsum(lengths)
                    for i in np.unique(np.searchsorted(ends, np.flatnonzero(p >= 0.5), "right")) if spans else ():
                        own = p[ends[i] - lengths[i]:ends[i]]
                        found[i] = [{"start": m.start(), "end": m.end(), "probability": float(q)}
                                    for m, q in zip(TOKEN.finditer(fold(texts[i])), own)
                                    if q >= 0.5]
                else:
                    s = np.zeros(len(texts))
                cols = [part.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64())]
                if spans:
                    cols.append(pa.array(found, SPANS))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "spans"][:len(cols)])

    schema = "doc_id long, score double" + (", spans array<struct<start:long,end:long,probability:double>>" if spans else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def q_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    place = lambda x: F.concat_ws(":", x.start.cast("string"), x.end.cast("string"))
    return score(docs, model, spans=True).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.array_join(F.transform("spans", place), ",").alias("spans"))
