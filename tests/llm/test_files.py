"""Operators 1 and 4: coding, archives and their round trips."""

import re
import gzip
import io
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
import public_tokenizers

from claimledger.llm import huffman, tokens, zipwarc
from claimledger.llm.common import materialize, scratch

PATH = public_tokenizers.path(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,!-  \x1c\x85sdtreve"), st.characters(exclude_categories=["Cs"])),
                    max_size=60))
def test_pieces_equal_the_whole_text(encoder, text):
    assert encoder.encode([text]) == [encoder.whole(text)]


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b", "it's 'store we'll", "x" * 5000, "a  b \n c\n d   ",
                                  "中文 ²½ 12ab", "don't,'s"])
def test_pieces_of_chosen_texts(encoder, text):
    assert encoder.encode([text]) == [encoder.whole(text)]


@settings(max_examples=60, deadline=None)
@given(counts=st.lists(st.integers(0, 10 ** 6), min_size=1, max_size=300), limit=st.integers(9, 16))
def test_code_lengths_are_a_limited_prefix_code(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and (used <= max(limit, 1)).all()
    if len(used) > 1:
        assert sum(2.0 ** -used) == 1.0


def test_code_lengths_are_best_under_the_limit():
    # Fibonacci counts would need 9 bits; by hand the best 4-bit code costs the same as exhaustive search
    counts, best = np.array([1, 1, 2, 3, 5, 8]), None
    for a in np.ndindex(*[4] * 6):
        lengths = np.array(a) + 1
        if sum(2.0 ** -lengths) <= 1:
            cost = int((counts * lengths).sum())
            best = cost if best is None else min(best, cost)
    assert int((counts * huffman.code_lengths(counts, 4)).sum()) == best


@settings(max_examples=40, deadline=None)
@given(ids=st.lists(st.integers(0, 70), min_size=1, max_size=1500))
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids), 16))
    blocks = []
    for i in range(0, len(ids), 400):
        data, marks, _ = code.encode(ids[i:i + 400])
        blocks.append((data, marks, len(ids[i:i + 400])))
    assert (code.decode(blocks) == ids).all()
    for i, b in enumerate(blocks):  # every block alone
        assert (code.decode([b]) == ids[i * 400:(i + 1) * 400]).all()


def expected_tokens(rows):
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(odd, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 1000)  # documents over several blocks
    got = [tuple(r) for r in tokens.read_files(tokens.store(odd)).orderBy("start").collect()]
    assert got == expected_tokens([(r.doc_id, r.text) for r in odd.collect()])


def test_token_files_of_nothing(empty):
    assert tokens.read_files(tokens.store(empty)).count() == 0


def test_wide_vocabulary_is_packed_whole():
    ids = np.array([0, 70000, 1 << 24], dtype="<u4")
    import zstandard
    raw = zstandard.ZstdCompressor().compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())
    assert (tokens.unpack_ids(raw, 3) == ids).all()


# ---------------------------------------------------------------- archives

class Bytes:
    """A file in memory with the reader's interface."""

    def __init__(self, raw):
        self.raw, self.size, self.reads = raw, len(raw), []

    def read(self, offset, n):
        self.reads.append((offset, n))
        return self.raw[offset:offset + n]


def package(n):
    sink = io.BytesIO()
    w = zipwarc.PackageWriter(sink)
    for i in range(n):
        w.add(zipwarc._record({"record_type": "response", "page_id": i, "url": f"http://h/{i}", "payload": b"p" * i,
                               "payload_digest": "0", "payload_bytes": i}), f"response\t{i}")
    w.close()
    return sink.getvalue()


@pytest.mark.parametrize("n", [0, 1, 50])
def test_package_is_a_zip_that_others_read(n):
    raw = package(n)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None
        assert z.namelist() == ["archive/data.warc.gz", "indexes/index.tsv"]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert z.read("indexes/index.tsv").count(b"\n") == n
        if n:
            assert gzip.decompress(z.read("archive/data.warc.gz")).count(b"WARC/1.1") == n


def test_records_are_read_by_ranges():
    f = Bytes(package(50))
    bodies = [len(body) for _, body in zipwarc.records(f)]
    assert bodies == list(range(50))
    reads = f.reads[-50:]
    archive = zipwarc.directory(f)["archive/data.warc.gz"]
    assert sum(n for _, n in reads) == archive["size"] and max(n for _, n in reads) < 400


def test_directory_of_a_plain_zip_with_a_comment():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a.txt", b"hello")
        z.writestr("b/c.txt", b"x" * 1000)
        z.comment = b"PK\x05\x06 is in the comment"
    f = Bytes(sink.getvalue())
    d = zipwarc.directory(f)
    assert f.read(zipwarc.data_start(f, d["a.txt"]), d["a.txt"]["size"]) == b"hello"
    assert f.read(zipwarc.data_start(f, d["b/c.txt"]), d["b/c.txt"]["size"]) == b"x" * 1000


def test_packed_members_are_refused():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", b"hello" * 100)
    f = Bytes(sink.getvalue())
    with pytest.raises(ValueError):
        zipwarc.data_start(f, zipwarc.directory(f)["a.txt"])


def test_archives(spark):
    big, small = "<p>" + "café " * 50, "<p>tiny"
    rows = [(5, "u5", big), (2, "u2", big), (9, "u9", big), (1, "u1", small), (3, "u3", small), (4, None, None),
            (6, "line\nbreak", ""), (None, "u", big), (7, "u7", "x" * 300000), (2, "u2", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first_id int")
    manifest = materialize(zipwarc.write_packages(zipwarc.record_types(pages.drop("first_id")), scratch(spark, "wacz")))
    got = zipwarc.read_packages(manifest).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to) for r in by[2]] == [("response", None)] * 2
    for k in (5, 9, None):
        assert (by[k][0].record_type, by[k][0].refers_to, by[k][0].payload_bytes) == ("revisit", 2, len(big.encode()))
    assert by[2][0].payload.decode() == big and by[7][0].payload == b"x" * 300000
    for k in (1, 3, 4, 6):
        assert by[k][0].record_type == "response"
    assert by[4][0].payload == b"" and by[4][0].payload_bytes == 0


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = materialize(zipwarc.write_packages(zipwarc.record_types(pages), scratch(spark, "wacz")))
    assert manifest.count() == 0 and zipwarc.read_packages(manifest).count() == 0


def test_the_fast_choice_finds_the_pieces_of_the_others():
    fast = f" ?[A-Za-z]++(?=[ {tokens.AFTER}])|"
    assert tokens.PIECE.pattern.startswith(fast)
    rng, slow = np.random.default_rng(6), re.compile(tokens.PIECE.pattern[len(fast):])
    for _ in range(2000):
        t = "".join(rng.choice(["a", "Bc", "\u00e9", "7", " ", "  ", "\n", "\u00a0", ",", ".", "'s", "-", "$", "\u4e2d"], 14))
        assert tokens.PIECE.findall(t) == slow.findall(t)


def test_only_new_pieces_are_handled_one_by_one(monkeypatch):
    encoder, seen = tokens.Encoder(PATH), {"split": 0, "words": 0}

    class Counting:
        def findall(self, text, split=tokens.PIECE.findall):
            seen["split"] += len(text)
            return split(text)

    monkeypatch.setattr(tokens, "PIECE", Counting())
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    texts = [" ".join(np.random.default_rng(k).choice(words, 400)) + ",\nEnd." for k in range(20)]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    assert seen["split"] < 100  # of 20 times 1600 characters
    encoder.words = lambda words: seen.update(words=seen["words"] + len(words)) or []
    assert encoder.encode(texts[::-1]) == [encoder.whole(t) for t in texts[::-1]] and seen["words"] == 0


def test_batches_of_texts_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 40)  # pieces are forgotten and found again
    encoder, rng = tokens.Encoder(PATH), np.random.default_rng(7)
    parts = ["a", "Bc", "\u00e9", "\u00d7", "\u02b0", "\u0416", "7", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u0085", "\u2003", "\u3000",
             "\u201cq\u201d", "\u2014", "\u1200", "\u1680", ",", ".", "'s", "'", "-", "$", "\u4e2d", "\U0001f600", "\x1c", "<|endoftext|>", "x" * 60]
    for _ in range(150):
        texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(12)]
        assert encoder.encode(texts, b"\2\0") == [encoder.whole(t) + b"\2\0" for t in texts]
        assert encoder.encode(pa.array(["cut", *texts, "off"]).slice(1, 12)) == [encoder.whole(t) for t in texts]
        assert len(encoder.known) <= 40


def test_small_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * n, None]}) for n in (10, 20, 5000, 30)]
    got = list(tokens.gathered(iter(batches), 1000))
    assert [b.num_rows for b in got] == [6, 2]
    assert [t for b in got for t in b.column(0).to_pylist()] == [t for b in batches for t in b.column(0).to_pylist()]
    assert list(tokens.gathered(iter([]), 1000)) == []
