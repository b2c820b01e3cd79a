"""Operator 1: token ids to Huffman-coded binary files.

1. Every text is encoded in place (no shuffle of texts); ids are stored in
   a table, and every task adds the counts of its ids.
2. The global counts, one row per id of the vocabulary, give the code.
3. The id rows are range-partitioned by doc_id, sorted, coded, and written
   as one file per partition; the manifest names the files in order.
4. Files are read back; the prefix sum of the manifest's counts places them.

The tokenizer splits a text before it merges, and never across the end of a
run of non-blank characters or between letters and punctuation.  So a text
is cut there, a batch of texts at once, and every distinct piece of the
batch is looked up among those that the process has encoded (a bounded
number of them); only new ones go to the library.  Texts that hold one of
the vocabulary's special strings, and tokenizers that split in another way,
are encoded whole.

Defined cases: null text is empty and gives the end id alone; null doc_ids
come first; repeated rows are separate documents next to each other; an
empty table gives no file and no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimledger.llm import huffman
from claimledger.llm.common import lean, materialize, parts, release, resident, scratch, table, text_slices
from claimledger.llm.files import Ranges, committed, make_dir

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Most pieces that a process keeps with their ids, and the longest one kept, in bytes.
CACHED, CACHED_CHARS = 1 << 20, 48
#: Bytes of texts that are encoded together, at least where there are as many.
TOGETHER = 2 << 20

# Fixed value: the characters of Unicode's White_Space property.
BLANK = "\t-\r \x85\xa0  -     　"
# A range of letters, and punctuation that no contraction starts with.
LATIN, AFTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af", r".,;:!?%*#&$|)\]\"-"
# The first choice is what the others would find, too, and found fastest: a plain word behind at most one space.
PIECE = re.compile(f" ?[A-Za-z]++(?=[ {AFTER}])|[{BLANK}]*+(?:[{LATIN}]++(?:(?=[{AFTER}])|[^{BLANK}]*+)|[^{BLANK}]++)|[{BLANK}]++")
#: Pieces that the splitter leaves whole (in UTF-8).
WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf]|\xca[\x80-\xaf])+|[0-9]+)")
#: Byte-level vocabularies write printable bytes as themselves, all others as characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
#: That character of every byte; the line feed, which no word holds, stays to keep words apart.
CHARS = np.arange(256, dtype="<u4")
CHARS[_OTHERS] = 256 + np.arange(len(_OTHERS))
CHARS[10] = 10

# Kinds of bytes: inside a character, other ASCII, space, other ASCII blanks, ASCII letters, AFTER, first bytes of
# characters that are no blanks, and of those that may be.
_INSIDE, _PLAIN, _SPACE, _CONTROL, _LETTER, _AFTER, _FIRST, _UNSURE = range(8)
KIND = np.full(256, _PLAIN, np.uint8)
KIND[128:192], KIND[192:], KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = _INSIDE, _FIRST, _UNSURE
KIND[[*b"\t\n\v\f\r"]], KIND[32] = _CONTROL, _SPACE
for _pattern, _kind in ((rb"[A-Za-z]", _LETTER), (f"[{AFTER}]".encode(), _AFTER)):
    KIND[[b for b in range(128) if re.fullmatch(_pattern, bytes([b]))]] = _kind
#: What two kinds next to each other tell: 1 cut before the first byte, 2 between them, 4 before the first unless
#: a wide blank follows, 8 between them if the second byte isn't a control, 16 between them if a letter ends there.
_PAIR = np.zeros((8, 8), np.uint8)
_SOLID = [_PLAIN, _LETTER, _AFTER]
_PAIR[_SPACE, [*_SOLID, _FIRST]] |= 1
_PAIR[_CONTROL, [*_SOLID, _FIRST]] |= 1 | 2
_PAIR[[_SPACE, _CONTROL], _UNSURE] |= 4
for _kind in _SOLID:
    _PAIR[_kind, [_SPACE, _CONTROL]] |= 2
_PAIR[_LETTER, _AFTER] |= 2
_PAIR[_INSIDE, _AFTER] |= 16
PAIR = _PAIR.ravel()
#: White space beyond ASCII as the bytes of its UTF-8, the two-byte ones ahead of any third byte.
WIDE = [int.from_bytes(c.encode(), "big") for c in map(chr, range(0x80, 0x3001)) if re.fullmatch(f"[{BLANK}]", c)]


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where UTF-8 texts that lie end to end, each from one of ``starts`` on
    (the end of the last one is among them), fall into pieces: the starts,
    and places the splitter never crosses and behind which it goes on as at
    the start of a text.  These are the last of a run of blanks before a
    character that is none, the end of that blank if it isn't a space, blanks
    behind other ASCII characters, and AFTER behind letters."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        kind = KIND[data]
        pair = PAIR[kind[:-1] << 3 | kind[1:]]
        inner = starts[(starts > 0) & (starts < n)]
        pair[inner - 1] = 0  # neighbours in two texts tell nothing
        cut[1:n] = pair & 2 != 0
        cut[:n - 1] |= pair & 1 != 0
        at = np.flatnonzero(pair & 20)
        if len(at):
            code = data[at].astype(np.int64)
            byte = lambda k: data[np.clip(at + k, 0, n - 1)].astype(np.int64)
            two = byte(1) << 8 | byte(2)
            blank = np.isin(two, WIDE) | np.isin(two << 8 | byte(3), WIDE)
            solid = (pair[at] & 4 != 0) & ~blank
            cut[at[solid]] = True
            cut[at[solid & (code != 32)] + 1] = True
            two = byte(-1) << 8 | code
            letter = (two >= 0xC380) & (two <= 0xCAAF) & (two != 0xC397) & (two != 0xC3B7)
            cut[at[(pair[at] & 16 != 0) & letter] + 1] = True
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """Texts to bytes of little-endian ids, 16 bits wide where the vocabulary
    fits, else 32."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        split = rules.get("pre_tokenizer") or {}
        self.by_piece = (split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
                         and split.get("use_regex", True) and not rules.get("normalizer")
                         and not rules.get("truncation") and not rules.get("padding"))
        self.special = [t["content"] for t in rules.get("added_tokens", []) if t["content"]]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind, self._array = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.known, self.ids = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())
        self.used = np.zeros(0, bool)

    @classmethod
    def of(cls, path: str) -> Encoder:
        return resident(("encoder", path), lambda: cls(path))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Words go to the library's model directly, as the characters that
        it has for their bytes."""
        if not words:
            return []
        chars = CHARS[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le").split("\n")
        tokenize, kind = self.tokenizer.model.tokenize, self._array
        return [array(kind, [t.id for t in tokenize(c)]).tobytes() for c in chars]

    def fresh(self, pieces: list[bytes], split: bool) -> list[bytes]:
        """Ids of pieces not yet known; ``split`` ones may fall into several
        by PIECE, which tells what no pair of bytes does."""
        out: list = [None] * len(pieces)
        words = [k for k, p in enumerate(pieces) if WORD.fullmatch(p)]
        for k, raw in zip(words, self.words([pieces[k] for k in words])):
            out[k] = raw
        others = {k: [x.encode() for x in PIECE.findall(pieces[k].decode())] if split else [pieces[k]]
                  for k, raw in enumerate(out) if raw is None}
        parts = list({x for xs in others.values() if len(xs) > 1 for x in xs})
        known = dict(zip(parts, self.pieces(pa.array(parts, pa.large_binary()), False).to_pylist())) if parts else {}
        for k, xs in others.items():
            out[k] = b"".join([known[x] for x in xs]) if len(xs) > 1 else self.whole(pieces[k].decode())
        return out

    def pieces(self, pieces: pa.Array, split: bool = True) -> pa.Array:
        """Ids of distinct pieces; those not yet known are encoded together."""
        known, ids = self.known, self.ids
        at = pc.index_in(pieces, value_set=known)
        lost = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().copy()
        self.used[at[~lost]] = True
        new = pieces.filter(pa.array(lost))
        found = pa.array(self.fresh(new.to_pylist(), split), pa.large_binary())
        at[lost] = len(known) + np.arange(len(new))
        out = pa.concat_arrays([ids, found]).take(pa.array(at))
        short = pc.less_equal(pc.binary_length(new), CACHED_CHARS)
        self.keep(new.filter(short), found.filter(short))
        return out

    def keep(self, pieces: pa.Array, ids: pa.Array) -> None:
        """Keep what was encoded; when that is more than CACHED, only what was
        used since the last time it was, of this the latest half."""
        self.known, self.ids = pa.concat_arrays([self.known, pieces]), pa.concat_arrays([self.ids, ids])
        self.used = np.append(self.used, np.ones(len(pieces), bool))
        if len(self.known) > CACHED:
            rest = pa.array(np.flatnonzero(self.used)[-CACHED // 2:])
            self.known, self.ids, self.used = self.known.take(rest), self.ids.take(rest), np.zeros(len(rest), bool)

    def encode(self, texts: list[str] | pa.Array, end: bytes = b"") -> list[bytes]:
        """Ids of each text, with ``end`` behind them."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        if not self.by_piece:
            return [self.whole(t) + end for t in texts.to_pylist()]
        if not len(texts):
            return []
        _, places, chars = texts.buffers()
        at = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(chars or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        ends = cuts(data, at)
        split = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        split = split.dictionary_encode()  # every distinct piece is looked up once
        _, places, raw = self.pieces(split.dictionary).take(split.indices).buffers()
        raw = memoryview(raw or b"")
        at = np.frombuffer(places, np.int64)[np.searchsorted(ends, at)].tolist()
        out = [b"".join((raw[a:b], end)) for a, b in zip(at, at[1:])]
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(special).tolist():
            out[k] = self.whole(texts[k].as_py()) + end
        return out


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Small batches as larger ones of at least that many bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield from held if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``docs`` (doc_id, text) -> rows (counts, doc_id, n, ids): one per
    document, ids compressed, and per task one row of counts per id."""
    schema = pa.schema([("counts", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end, pack = np.array([end_id], encoder.kind).tobytes(), zstandard.ZstdCompressor(level=1)
        seen = np.zeros(max(encoder.size, end_id + 1), np.int64)
        for batch in gathered(batches, TOGETHER):
            for part in text_slices(batch, "text", 4 * TOGETHER):
                raw = encoder.encode(pc.fill_null(part.column("text"), ""), end)
                ids = [np.frombuffer(x, encoder.kind) for x in raw]
                seen += np.bincount(np.frombuffer(b"".join(raw), encoder.kind), minlength=len(seen))
                # planes of bytes compress better than interleaved ones
                packed = [pack.compress(np.frombuffer(x, np.uint8).reshape(len(i), -1).T.tobytes())
                          for x, i in zip(raw, ids)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([False] * len(ids)), part.column("doc_id").cast(pa.int64()),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())], schema=schema)
        yield pa.RecordBatch.from_pydict({"counts": [True], "doc_id": [None], "n": [0],
                                          "ids": [pack.compress(seen.tobytes())]}, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "counts boolean, doc_id long, n long, ids binary")


def unpack_ids(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(-1, n)
    out = planes[0].astype(np.uint32)
    for k, plane in enumerate(planes[1:], 1):
        out |= plane.astype(np.uint32) << np.uint32(8 * k)
    return out


def global_counts(encoded: DataFrame) -> np.ndarray:
    """Occurrences of every id; the driver gets one row per id that occurs."""
    def run(batches):
        total = None
        for b in batches:
            for raw in b.column("ids").to_pylist():
                one = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)
                total = one.copy() if total is None else total + one
        if total is not None:
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"id": ids, "n": total[ids]},
                                             schema=pa.schema([("id", pa.int64()), ("n", pa.int64())]))

    rows = (encoded.where("counts").select("ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(int(rows.num_rows and pc.max(rows["id"]).as_py()) + 1, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write_files(encoded: DataFrame, lengths: np.ndarray, folder: str) -> DataFrame:
    """Write the documents of ``encoded`` in order of doc_id; returns the
    manifest (place, path, ids), to be stored before it is used."""
    make_dir(folder)
    known = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # the encoder and its pieces would stay next to the files' buffers
        rows = ((d, n, raw) for b in batches for part in text_slices(b, "ids")
                for d, n, raw in zip(*[part.column(c).to_pylist() for c in ("doc_id", "n", "ids")]))
        first = next(rows, None)
        if first is None:
            return
        place = TaskContext.get().partitionId()
        path = f"{folder}/tokens-{place:06d}-{TaskContext.get().taskAttemptId()}.huf"
        with committed(path) as sink:
            w = huffman.Writer(sink, huffman.Code(np.frombuffer(known, np.uint8)))
            w.add(first[0], unpack_ids(first[2], first[1]))
            for d, n, raw in rows:
                w.add(d, unpack_ids(raw, n))
            w.close()
        yield pa.RecordBatch.from_pydict({"place": [place], "path": [path], "ids": [w.total]},
                                         schema=pa.schema([("place", pa.int64()), ("path", pa.string()),
                                                           ("ids", pa.int64())]))

    n = parts(encoded.sparkSession)
    return (encoded.where("NOT counts").select("doc_id", "n", "ids").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
            .mapInArrow(run, "place long, path string, ids long"))


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                with Ranges(path) as f:
                    docs = huffman.documents(f)
                    left, crcs, crc, k = docs[:, 2].copy(), np.zeros(len(docs), np.int64), 0, 0
                    for ids in huffman.read_ids(f):
                        raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                        while at < len(ids):
                            n = min(int(left[k]), len(ids) - at)
                            crc = zlib.crc32(raw[at * 4:(at + n) * 4], crc)
                            at, left[k] = at + n, left[k] - n
                            if not left[k]:
                                crcs[k], crc, k = crc, 0, k + 1
                    ends = start + np.cumsum(docs[:, 2])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[:, 0], mask=docs[:, 1] == 1), pa.array(ends - docs[:, 2]),
                         pa.array(np.ascontiguousarray(docs[:, 2])), pa.array(crcs)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per file, in order; only these few rows are numbered in one place
    before = F.coalesce(F.sum("ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (manifest.select("path", before.alias("before")).repartition(parts(manifest.sparkSession), "path")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def store(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 16) -> DataFrame:
    """Encode, code and write ``docs``; returns the stored manifest."""
    spark = docs.sparkSession
    lean(spark)
    encoded = materialize(encode_documents(docs, public_tokenizers.path(vocabulary)))
    lengths = huffman.code_lengths(global_counts(encoded), limit)
    return materialize(write_files(encoded, lengths, scratch(spark, "tokens")))


def q_tokens(spark, sf_dir):
    return read_files(store(table(spark, sf_dir, "documents").select("doc_id", "text")))
