"""Operator 5: secret scan by rules and a character convolutional network.

The base rules give findings of kinds assign, access and hex.  Every
candidate is then read by a small convolutional network in numpy together
with its surroundings.  A candidate is a maximal run of at least SHORTEST
token characters (dots and dashes at its ends left out) that holds a digit,
a symbol or a capital behind its first character, or follows an assignment
sign, or has LONG characters; every base finding's value is one.  Runs are
read whole, in pieces of PIECE characters, and score as their best piece.
Candidates whose score passes the threshold and that base findings do not
cover are added as kind ``model``; base findings always stay, with the best
score of the candidates that touch them.

The network learns from all labelled findings: candidates of every document,
labelled by whether a base finding touches them, piece by piece.  Positive
pieces are also shown cut short and amid the surroundings of others, so that
the shape of a value counts and not only the name before it.  Pieces are
stored once, equal ones with their number, and dealt to tasks of about SHARE; every task goes on from
the round's network, and the mean of what they reach begins the next round.
The rounds of a pass see every piece once; small tables are passed more than
once.  Documents held back from training (a quarter, by the hash of their id)
calibrate the scores (Platt, Newton steps over sums of all their candidates)
and set the threshold: the highest at which RECALL of all their labelled
findings still pass.  ``Network.recall`` tells the share reached by length
of the candidate.  The driver gets sums, and a network from each task.

Defined cases: null text is empty and has no span; very long texts and very
long candidates are scanned whole; without labelled findings
no span is added and base findings score 1; repeated rows are scanned each;
ties in a span list go by kind in the order listed, then by end; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import lean, materialize, table, text_slices
from claimledger.operators.ordered import cumulative_counts

RECALL = 0.98
#: Pieces that a task learns from in a round, rounds of a pass over many pieces, pieces to see in all where a table has fewer.
SHARE, ROUNDS, SEEN, PASSES = 8192, 8, 1 << 17, 6
SHORTEST, LONG = 6, 16
PIECE, SIDE = 48, 16
WIDTH, EMBED, FILTERS, KERNEL, HIDDEN = PIECE + 2 * SIDE, 8, 32, 5, 24

# The base rules of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
#: The same runs, found faster: only those long enough.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Lower-cased parts of the names; a text without any has no assign finding.
NAMES = ("password", "passwd", "secret", "token", "api")
RUN = "[A-Za-z0-9+/_.=-]"
#: Runs with a digit, a symbol or a capital behind the first character; runs
#: behind an assignment sign; long runs of any kind.
MARKED = re.compile(rf"(?<!{RUN})(?:[0-9+/_=]|[A-Za-z.-][a-z.-]*+[0-9A-Z+/_=]){RUN}*")
ASSIGNED = re.compile(rf"[:=][\"']?\x20*[\"']?(?<!{RUN})({RUN}{{{SHORTEST},}})")
LONG_RUN = re.compile(rf"(?<!{RUN}){RUN}{{{LONG},}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, kinds by place in KINDS."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    spans = [m.span() for p in (MARKED, LONG_RUN) for m in p.finditer(text)]
    spans += [m.span(1) for m in ASSIGNED.finditer(text)]
    out = set()
    for a, b in spans:
        if b - a >= SHORTEST:
            run = text[a:b]
            a, b = b - len(run.lstrip(".-")), a + len(run.rstrip(".-"))
            if b - a >= SHORTEST:
                out.add((a, b))
    return sorted(out)


def touches(span: tuple[int, int], base: list[tuple[int, int, int]]) -> bool:
    return any(s < span[1] and span[0] < e for s, _, e in base)


def covered(span: tuple[int, int], base: list[tuple[int, int, int]]) -> bool:
    """Whether base findings (by start) leave no character of the span."""
    at = span[0]
    for s, _, e in base:
        if s <= at < e:
            at = e
    return at >= span[1]


def window(text: str, a: int, b: int) -> str:
    left, right = text[max(0, a - SIDE):a].rjust(SIDE, "\0"), text[b:b + SIDE].ljust(SIDE, "\0")
    return left + text[a:b].ljust(PIECE, "\0") + right


def windows(text: str, span: tuple[int, int]) -> list[str]:
    """Pieces of a candidate with what stands around each, padded."""
    return [window(text, a, min(a + PIECE, span[1])) for a in range(span[0], span[1], PIECE)]


def codes(found: list[str]) -> np.ndarray:
    """Characters as 0..127, all beyond ASCII as 127."""
    raw = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(found), WIDTH)
    return np.minimum(raw, 127).astype(np.int64)


class Network:
    """Embedding, one convolution, pooling by maximum over the candidate and
    over either side, one hidden layer."""

    PARTS = (slice(0, SIDE), slice(SIDE, SIDE + PIECE), slice(SIDE + PIECE - KERNEL + 1, WIDTH - KERNEL + 1))

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.normal(size=shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        self.p = {"embed": (rng.normal(size=(128, EMBED)) * 0.5).astype(np.float32),
                  "conv": make(KERNEL * EMBED, FILTERS), "conv_b": np.zeros(FILTERS, np.float32),
                  "hide": make(3 * FILTERS, HIDDEN), "hide_b": np.zeros(HIDDEN, np.float32),
                  "out": make(HIDDEN, 1), "out_b": np.zeros(1, np.float32)}
        self.platt = (1.0, 0.0)
        self.threshold = 2.0
        self.recall: dict[str, float] = {}

    def _forward(self, x: np.ndarray):
        p = self.p
        e = p["embed"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2)
        cols = np.ascontiguousarray(cols).reshape(len(x), WIDTH - KERNEL + 1, KERNEL * EMBED)
        c = np.maximum(cols @ p["conv"] + p["conv_b"], 0)
        best = [c[:, part].argmax(axis=1) + part.start for part in self.PARTS]
        pooled = np.concatenate([np.take_along_axis(c, b[:, None, :], 1)[:, 0] for b in best], axis=1)
        h = np.maximum(pooled @ p["hide"] + p["hide_b"], 0)
        return (h @ p["out"] + p["out_b"])[:, 0], (cols, best, pooled, h)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k:k + 512])[0] for k in range(0, len(x), 512)] or [np.zeros(0)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -30, 30)))

    def _gradients(self, x, y, weight):
        p = self.p
        z, (cols, best, pooled, h) = self._forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / weight.sum()).astype(np.float32)[:, None]
        g = {"out": h.T @ d, "out_b": d.sum(axis=0)}
        dh = (d @ p["out"].T) * (h > 0)
        g |= {"hide": pooled.T @ dh, "hide_b": dh.sum(axis=0)}
        dp = (dh @ p["hide"].T) * (pooled > 0)
        # only the best place of a filter in each part has a gradient
        at = np.concatenate(best, axis=1)
        dp, places = dp.reshape(len(x), -1, FILTERS), at.reshape(len(x), -1, FILTERS)
        seen = cols[np.arange(len(x))[:, None, None], places]
        g |= {"conv": (dp[..., None] * seen).sum(axis=(0, 1)).T, "conv_b": dp.sum(axis=(0, 1))}
        de = (dp[..., None] * p["conv"].T).reshape(-1, EMBED)
        letters = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(KERNEL)].ravel()
        ge = np.stack([np.bincount(letters, column, 128) for column in de.T], axis=1)
        return g | {"embed": ge.astype(p["embed"].dtype)}

    def fit(self, x: np.ndarray, y: np.ndarray, times: np.ndarray, epochs: int = PASSES, batch: int = 64,
            rate: float = 0.004, seed: int = 11) -> None:
        """From pieces that occur ``times`` each."""
        rng = np.random.default_rng(seed)
        good = (times * y).sum()
        weight = np.where(y == 1, 0.5 / max(1, good), 0.5 / max(1, times.sum() - good)) * times * len(y)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        n = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                own = order[k:k + batch]
                n += 1
                for key, g in self._gradients(x[own], y[own], weight[own]).items():
                    m, v = state[key]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[key] -= rate * (m / (1 - 0.9 ** n)) / (np.sqrt(v / (1 - 0.999 ** n)) + 1e-7)

    def calibrate(self, scored: DataFrame) -> None:
        """By candidates (best logit ``z`` of the pieces, label ``y``,
        ``length``), all of them; every step is an aggregate."""
        a, b = 1.0, 0.0
        z, y = F.col("z"), F.col("y")
        for _ in range(50):  # Platt: a logistic curve of the logit, a little ridge for separable scores
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(float(a)) * z + F.lit(float(b))))))
            w, d = p * (1 - p), y - p
            r = scored.agg(*[F.sum(c) for c in (w * z * z, w * z, w, d * z, d)]).first()
            step = np.linalg.solve([[r[0] + 1, r[1]], [r[1], r[2] + 1]], [r[3] - (a - 1), r[4] - b])
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.platt = (a, b)
        up = 1.0 if a >= 0 else -1.0  # scores rise with the logit, or fall
        found = scored.where(y == 1).select((z * F.lit(up)).alias("z"), "length")
        n = found.count()
        if n:
            low = int((1 - RECALL) * n)
            least = (cumulative_counts(found, [], "z").where((F.col("before") <= low) & (F.col("before") + F.col("cnt") > low))
                     .first()["z"])
            self.threshold = float(1 / (1 + np.exp(-np.clip(a * least * up + b, -30, 30))))
            name = F.when(F.col("length") < 16, "6-15").when(F.col("length") < 49, "16-48").otherwise("49+")
            self.recall = {r["name"]: r["share"] for r in found.groupBy(name.alias("name")).agg(
                F.avg((F.col("z") >= F.lit(least)).cast("int")).alias("share")).collect()}


def labelled_findings(docs: DataFrame) -> DataFrame:
    """All candidates of all documents, stored: document hash, place, pieces,
    label of each piece, label, length, and whether the document is held
    back from training."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b, "text"):
                out = []
                for h, t in zip(part.column("h").to_pylist(), part.column("text").to_pylist()):
                    base = base_spans(t or "")
                    for c in candidates(t or ""):
                        marks = [int(touches((a, min(a + PIECE, c[1])), base)) for a in range(c[0], c[1], PIECE)]
                        out.append((h, c[0], windows(t, c), marks, int(touches(c, base)), c[1] - c[0]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)],
                                                     names=["h", "at", "w", "marks", "y", "length"])

    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("secrets"))
    found = docs.select(h.alias("h"), "text").mapInArrow(
        run, "h long, at long, w array<string>, marks array<long>, y long, length long")
    return materialize(found.withColumn("held", F.col("h") % 4 == 0))


def _elsewhere(found: np.ndarray, other: np.ndarray, rng) -> np.ndarray:
    """Findings as they would stand at other places: the end of the value,
    of any length from 16 on, with the sides of other windows."""
    out = other.copy()
    for row, x in zip(out, found[:, SIDE:SIDE + PIECE]):
        n = int((x > 0).sum())
        size = int(rng.integers(min(16, n), n + 1))
        row[SIDE:SIDE + PIECE] = 0
        row[SIDE:SIDE + size] = x[n - size:n]
    return out


def _fitted(p: dict, x: np.ndarray, marks: np.ndarray, times: np.ndarray, epochs: int, rate: float, seed: int) -> dict:
    """Weights reached from ``p`` by these pieces."""
    rng = np.random.default_rng(seed)
    net, good = Network(), x[marks == 1]
    net.p = {k: v.copy() for k, v in p.items()}
    mixed = [_elsewhere(good, x[rng.choice(len(x), len(good))], rng) for _ in (1, 2)]
    net.fit(np.concatenate([x, *mixed]), np.concatenate([marks, np.ones(2 * len(good))]),
            np.concatenate([times, np.tile(times[marks == 1], 2)]), epochs, rate=rate, seed=seed + 8)
    return net.p


def _rounds(net: Network, pieces: DataFrame, n: int) -> None:
    """Teach ``net`` by ``n`` ``pieces`` (order, w, mark, times)."""
    passes = min(PASSES, max(1, SEEN // n))
    alone = n <= 2 * SHARE  # one task makes all passes itself
    slices = 1 if alone else max(1, ROUNDS // passes)
    tasks = 1 if alone else -(-n // (slices * SHARE))
    dealt = F.pmod(F.col("order"), F.lit(slices * tasks))
    pieces = materialize(pieces.select("order", "w", "mark", "times", (dealt % slices).alias("slice"),
                                       F.floor(dealt / slices).cast("long").alias("task")))
    names, total = list(net.p), 1 if alone else passes * slices
    for k in range(total):
        p, rate = net.p, 0.004 * (1 - 0.75 * k / total)

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("order", "ascending"), ("w", "ascending"), ("mark", "ascending")])
            marks, times = (t[c].to_numpy().astype(np.float64) for c in ("mark", "times"))
            got = _fitted(p, codes(t["w"].to_pylist()), marks, times, passes if alone else 1, rate, 3 + k)
            return pa.table({"task": t["task"][:1], "n": [t.num_rows],
                             "weights": pa.array([np.concatenate([got[x].ravel() for x in names]).tolist()], pa.list_(pa.float32()))})

        got = (pieces.where(F.col("slice") == k % slices).repartition(tasks, "task").groupBy("task")
               .applyInArrow(run, "task long, n long, weights array<float>").toArrow().sort_by("task"))
        if not got.num_rows:
            continue
        mean = np.average(np.array(got["weights"].to_pylist()), axis=0, weights=got["n"].to_numpy())
        ends = np.cumsum([p[x].size for x in names])
        net.p = {x: m.reshape(p[x].shape).astype(np.float32) for x, m in zip(names, np.split(mean, ends[:-1]))}


def learn(docs: DataFrame) -> Network | None:
    """A network from the labelled findings of ``docs``, or None without any."""
    lean(docs.sparkSession)
    found = labelled_findings(docs)
    size = {(r["held"], r["y"]): r["n"] for r in found.groupBy("held", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(size.get((held, y), 0) for held in (True, False) for y in (0, 1)) < 3:
        return None
    # pieces of a finding that its base span doesn't touch teach nothing
    pieces = found.where("NOT held").select("y", F.explode(F.arrays_zip("w", "marks")).alias("p")).where("p.marks = y")
    # equal pieces of one label are learnt from together, as often as they occur
    pieces = materialize(pieces.groupBy("p.w", F.col("p.marks").alias("mark")).agg(F.count(F.lit(1)).alias("times"))
                         .withColumn("order", F.xxhash64("w", "mark")))
    net = Network()
    _rounds(net, pieces, pieces.count())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("w").to_pylist()
            z = best_scores(net.logits, own, [(i, w) for i, ws in enumerate(own) for w in ws])
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), b.column("y"), b.column("length")], names=["z", "y", "length"])

    net.calibrate(materialize(found.where("held").select("w", "y", "length").mapInArrow(best, "z double, y long, length long")))
    return net


def best_scores(score, owners: list, pieces) -> list[float]:
    """Highest ``score`` of the pieces (place of the owner, window) of each owner, pieces in bounded batches."""
    best, waiting, owner = np.full(len(owners), -np.inf), [], []

    def flush():
        if waiting:
            np.maximum.at(best, owner, score(codes(waiting)))
            waiting.clear()
            owner.clear()

    for k, w in pieces:
        waiting.append(w)
        owner.append(k)
        if len(waiting) >= 4096:
            flush()
    flush()
    return best.tolist()


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id and findings: (kind, start, end,
    score), in code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                bases = [base_spans(t) for t in texts]
                best = [[0.0 if net else 1.0] * len(base) for base in bases]
                added = [[] for _ in texts]
                open_ = [(i, c) for i, t in enumerate(texts) for c in candidates(t)] if net else []
                for k in range(0, len(open_), 4096):
                    own = open_[k:k + 4096]
                    for (i, c), q in zip(own, best_scores(
                            net.scores, own, ((j, w) for j, (i, c) in enumerate(own) for w in windows(texts[i], c)))):
                        for j, (s, _, e) in enumerate(bases[i]):
                            if s < c[1] and c[0] < e:
                                best[i][j] = max(best[i][j], q)
                        if q >= net.threshold and not covered(c, bases[i]):
                            added[i].append((c[0], 3, c[1], q))
                out = [[(*x, q) for x, q in zip(b, p)] + a for b, p, a in zip(bases, best, added)]
                found = [[{"kind": KINDS[k], "start": s, "end": e, "score": q} for s, k, e, q in sorted(o)] for o in out]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(found, FINDINGS)],
                                                 names=["doc_id", "findings"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, findings array<struct<kind:string,start:long,end:long,score:double>>")


FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def q_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs))
    name = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("findings", lambda x: x.kind != "model"), name), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.transform("findings", name), ",").alias("spans"))
