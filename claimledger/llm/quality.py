"""Operator 12: document quality by compression against two dictionaries.

Text of good and of bad labelled documents makes one zstandard raw-content
dictionary each.  A text is cut into short blocks, every block is compressed
with both, and the sizes are summed over the whole text; their difference
over their sum, positive where the good dictionary fits better, is the one
feature, and a logistic curve fitted on labelled documents that are in no
dictionary (Platt scaling) makes it a score.

What is compressed is a text's form: letters become ``a`` or ``A``, digits
``9``, a word that repeats the one before it ``=``; punctuation and white
space stay.  So a passage that stands in many documents, or a language with
few labelled ones, weighs no more than its form does.  Blocks are short
because a long one would compress against itself.

Learning reads at most SAMPLE_DOCS labelled documents of each class for the
dictionaries, DICTIONARY_BYTES each, and at most CALIBRATION_DOCS for the
curve, those of the smallest id hashes (documented bounds of the classifier,
the only sample here).  They are chosen among the labels alone, so that a
bounded list of ids goes to the texts by broadcast and no text is shuffled.

Defined cases: null and empty texts have feature 0 and the score of that;
a very long text is scored whole, in time and memory proportional to its
length; ties are scored alike; repeated rows are scored each, and count once
in learning; labels other than 0 and 1, null labels and null ids are not
learned from; with labels of one class only, every score is that class's
smoothed share, and one half without labels; an empty table gives an empty
result; extra columns pass through (columns named like an output column are
replaced).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import held_out, lean, materialize, table

BLOCK, LEVEL = 128, 3
DICTIONARY_BYTES = 128 << 10
SAMPLE_DOCS, CALIBRATION_DOCS = 800, 4000
#: One labelled document in RESERVE is for the curve.
RESERVE = 5
#: Characters of a document's piece at least, and of the longest one, in a dictionary.
PIECE = (200, 16 << 10)

REPEATED = re.compile(r"(?<!\S)(\S++)(?:\s+\1(?!\S))+")
UPPER, LETTER, DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_A]"), re.compile(r"\d")


def form(text: str | None) -> bytes:
    """The text with letters, digits and repeated words written by kind."""
    text = REPEATED.sub(lambda m: m.group(1) + " =" * (len(m.group().split()) - 1), text or "")
    return DIGIT.sub("9", LETTER.sub("a", UPPER.sub("A", text))).encode()


@dataclass(frozen=True)
class Quality:
    """What is learned: the dictionaries (bad, good), and the curve's slope and place."""

    dictionaries: tuple[bytes, bytes]
    slope: float
    place: float


class Model:
    """A Quality ready for use; a task builds its own."""

    def __init__(self, learned: Quality):
        self.learned = learned
        self.compressors = []
        for raw in learned.dictionaries if all(learned.dictionaries) else ():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False,
                                                             write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """Compressed size against the bad less that against the good dictionary, over their sum."""
        if not self.compressors:
            return 0.0
        raw = memoryview(form(text))
        blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        bad, good = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        return (bad - good) / max(1, bad + good)

    def score(self, text: str | None) -> float:
        x = self.learned.slope * self.difference(text) + self.learned.place
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, place) of the logistic curve of labels ``y`` on ``x`` (Newton steps)."""
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame) -> Quality:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, label) -> what scoring needs."""
    lean(docs.sparkSession)
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    lab = (labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id")
           .agg(F.min("label").cast("int").alias("label")).withColumn("h", h))
    kept = F.pmod("h", F.lit(RESERVE)) == 0
    first = lambda rows, n, use: rows.orderBy("h", "doc_id").limit(n).select("doc_id", "label", F.lit(use).alias("use"))
    chosen = first(lab.where(kept), CALIBRATION_DOCS, "curve")
    for label in (0, 1):
        chosen = chosen.unionByName(first(lab.where(~kept & (F.col("label") == label)), SAMPLE_DOCS, "dictionary"))
    # at most 2 * SAMPLE_DOCS + CALIBRATION_DOCS ids
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(materialize(chosen)), "doc_id"))
    words = texts.where("use = 'dictionary' AND length(text) > 0")
    number = {r["label"]: r["n"] for r in words.groupBy("label").agg(F.count_distinct("doc_id").alias("n")).collect()}
    length = F.lit(0)
    for label, n in number.items():  # pieces fill a dictionary about twice, whatever their number
        length = F.when(F.col("label") == label, min(max(2 * DICTIONARY_BYTES // n, PIECE[0]), PIECE[1])).otherwise(length)
    at = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - length, F.lit(1))) + 1
    pieces = (words.select("doc_id", "label", F.substr("text", at.cast("int"), length).alias("piece"))
              .groupBy("doc_id", "label").agg(F.min("piece").alias("piece")))
    found: tuple[list, list] = ([], [])
    for r in pieces.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        found[r["label"]].append(form(r["piece"]))
    both = tuple(b"\n".join(f)[-DICTIONARY_BYTES:] for f in found)
    if not all(both):
        n = {r["label"]: r["n"] for r in lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        return Quality((b"", b""), 0.0, math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))
    raw = Quality(both, 1.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(raw)
        for b in batches:
            x = [model.difference(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("label"),
                                              pa.array(x, pa.float64())], names=["doc_id", "label", "x"])

    curve = (texts.where("use = 'curve'").select("doc_id", "label", "text")
             .mapInArrow(run, "doc_id string, label int, x double").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
             .select("label", "x").collect())
    if not curve:
        return raw
    return Quality(both, *logistic(np.array([r["x"] for r in curve]), np.array([float(r["label"]) for r in curve])))


def score(docs: DataFrame, learned: Quality, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score and predicted added, from text alone."""
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(learned)
        for b in batches:
            got = [model.score(t.as_py()) for t in b.column("text")]
            cols = [pa.array(got, pa.float64()), pa.array([int(x >= threshold) for x in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "score", "predicted"])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def q_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    learned = learn(docs.where(~F.col("held_out")), labels.where(~held_out(F.col("doc_id"), 3, 1)))
    return score(docs, learned).drop("text")
