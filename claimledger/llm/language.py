"""Operator 9: language ID by compression against per-language dictionaries.

A language is a zstandard raw-content dictionary: text of that language.  A
text is cut into blocks of BLOCK bytes, every block is compressed with each
dictionary, and the sizes are summed over the whole text; the language
whose dictionary gives the smallest sum wins.  Blocks keep the dictionary
useful at any length (one long text would soon compress against itself) and
bound memory.  The score is a logistic curve of the margin, the saving of
the best over the second language, as a share of the second's size; where
the saving is narrow, ``rejected`` is set: texts of languages that were not
learned and runs of letters that are no language fit all dictionaries about
equally badly.  Savings under MIN_BYTES bytes are chance, whatever their
share of a short text, and count as none; with that, the narrow saving is
the one below which LOST of labelled documents lie.

Learning: dictionaries hold at most DICTIONARY_BYTES, cut from a sample of
at most SAMPLE_DOCS labelled documents per language (the smallest id
hashes; both are documented bounds of the dictionaries, the only sample
here).  One labelled document in RESERVE stays out of the dictionaries, in
languages that have enough to fill them; all of these set the narrow saving,
from counts of their savings in steps of 1 / STEPS.  Where they are too few to
tell LOST of them it is NARROW, and it is never below the curve's midpoint.  The midpoint and slope
are constants of the margin's scale.

Defined cases: null text, empty text and text without a letter give ``und``
with score 0, rejected; a table without labelled documents gives ``und``
for all; ties go to the language with most labelled documents; repeated rows are
scored each; extra columns are ignored by learning and pass through
(``identify`` replaces columns of its own output's names).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimledger.llm.common import held_out, lean, resident, table

BLOCK = 2048
DICTIONARY_BYTES = 128 << 10
SAMPLE_DOCS = 400
LEVEL = 3
#: Saving at which the score is one half, and the curve's width.
MIDDLE, WIDTH = 0.01, 0.01
#: Share of labelled documents that may be rejected, the bytes that a best language saves at least,
#: and the narrow saving where too few documents are labelled.
LOST, MIN_BYTES, NARROW = 0.015, 5, 0.03
#: One labelled document in RESERVE is for the margin; savings are counted in steps.
RESERVE, STEPS = 8, 1_000_000

LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> bytes:
    return " ".join(LETTERS.findall((text or "").lower())).encode()


class Dictionaries(dict):
    """Dictionary text per language, and the saving below which a text is rejected."""

    narrow = NARROW


def learn(labelled: DataFrame) -> Dictionaries:
    """``labelled`` (doc_id, text, lang) -> dictionary text per language.

    The sample is found in two steps: the number of labelled documents per
    language gives the hash range that holds about four times SAMPLE_DOCS
    of them, and of these the smallest hashes are taken.  Only the sampled
    rows' pieces reach the driver."""
    lean(labelled.sparkSession)
    d = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Dictionaries()
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("margin"))
    reserved = (F.col("lang").isin([k for k, n in counts.items() if n > 2 * SAMPLE_DOCS])
                & (F.pmod(h, F.lit(RESERVE)) == 0))
    margin, d = d.where(reserved), d.where(~reserved)
    share, length = F.lit(0.0), F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 4.0 * SAMPLE_DOCS / n)).otherwise(share)
        # pieces fill the dictionary about twice, whatever their number
        length = F.when(F.col("lang") == lang, 2 * DICTIONARY_BYTES // min(SAMPLE_DOCS, n)).otherwise(length)
    d = d.withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("dictionary")))
    d = d.where(F.col("h") / F.lit(2.0 ** 64) + 0.5 <= share)
    # the piece starts anywhere in the text, so that openings don't dominate
    size = F.length("text")
    at = F.pmod(F.xxhash64("h"), F.greatest(size - length, F.lit(1))) + 1
    d = d.select("lang", "h", F.substr("text", at.cast("int"), length).alias("piece"))
    rank = Window.partitionBy("lang").orderBy("h", "piece")
    d = d.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= SAMPLE_DOCS)
    pieces: dict[str, list[str]] = {}
    for r in d.orderBy("lang", F.desc("r")).collect():
        pieces.setdefault(r["lang"], []).append(r["piece"])
    order = sorted(pieces, key=lambda k: (-counts[k], k))
    out = Dictionaries({k: letters(" ".join(pieces[k]))[-DICTIONARY_BYTES:] for k in order})
    out.narrow = _narrow(margin, out)
    return out


def _narrow(labelled: DataFrame, dictionaries: Dictionaries) -> float:
    """The saving below which LOST of the ``labelled`` documents lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(dictionaries)
        for b in batches:
            got = [int(model.predict(t.as_py())[2] * STEPS) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["step"])

    steps = (labelled.select("text").mapInArrow(run, "step long").groupBy("step").agg(F.count(F.lit(1)).alias("n"))
             .orderBy("step").collect())
    at = int(LOST * sum(r["n"] for r in steps))
    if not at:
        return NARROW
    for r in steps:
        at -= r["n"]
        if at < 0:
            break
    return max(MIDDLE, r["step"] / STEPS)


class Model:
    """Dictionaries ready for use, built once while a Python process has no other model."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = list(texts)
        self.narrow = getattr(texts, "narrow", NARROW)
        self.compressors = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(texts[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False,
                                                             write_checksum=False, write_dict_id=False))

    @classmethod
    def of(cls, texts: dict[str, bytes]) -> Model:
        key = ("language", *texts.items(), getattr(texts, "narrow", NARROW))
        return resident(key, lambda: cls(texts))

    def sizes(self, raw: bytes) -> list[int]:
        view = memoryview(raw)
        blocks = [view[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, saving)."""
        raw = letters(text)
        # runs of letters may hold numerals that are no digits
        if not raw or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        sizes = self.sizes(raw)
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        best, second = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))[:2]
        saving = 1 - sizes[best] / sizes[second] if sizes[second] - sizes[best] >= MIN_BYTES else 0.0
        return self.langs[best], 1 / (1 + math.exp((MIDDLE - saving) / WIDTH)), saving

    def rejects(self, language: str, score: float, saving: float) -> bool:
        return language == "und" or saving < self.narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score and rejected added, from text alone."""
    added = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()),
             ("rejected", "boolean", pa.bool_())]
    docs = docs.drop(*[a for a, _, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(dictionaries)
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column("text")]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                    pa.array([model.rejects(*g) for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *[a for a, _, _ in added]])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, *[f"{a} {t}" for a, t, _ in added]]))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` without the documents that are rejected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(dictionaries)
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column("text")]
            yield b.filter(pa.array([not model.rejects(*g) for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def q_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    dictionaries = learn(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), dictionaries).drop("text")
