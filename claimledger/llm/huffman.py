"""Length-limited canonical Huffman coding of token ids, and its file format.

The code comes from counts alone: package-merge gives the best lengths
under a limit, codes are assigned in order of (length, id), so a file needs
only the lengths.  A file holds independent blocks of BLOCK ids; a block
lists the bit offset of every STEP-th id, so that decoding runs many lanes
at once (each step one table look-up for all lanes) and can start anywhere.

File: head (magic, number of ids known to the code, longest code, a length
byte per id), blocks (ids u32, checkpoints u32 of bit offsets, bits u64,
then the bits from the highest down), tail (documents: id, null flag,
number of ids), and the tail's offset with the magic again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK, STEP = 1 << 17, 128
MAGIC = b"HUFTOK1\n"
HEAD, BLOCK_HEAD, END = struct.Struct("<8sII"), struct.Struct("<IIQ"), struct.Struct("<QQ8s")


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Code length per id (0: the id doesn't occur), best for ``counts``
    among all prefix codes of at most ``limit`` bits; the limit grows where
    that many codes don't exist."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    w = counts[used].astype(np.int64)
    level, leaf = w, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = len(level) // 2 * 2
        both = np.concatenate([w, level[0:m:2] + level[1:m:2]])
        order = np.argsort(both, kind="stable")
        leaf.append(order < n)
        level = both[order]
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(leaf):
        leaves = int(flags[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = out
    return lengths


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = int(lengths.max(initial=1))
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]
        own = lengths[ids].astype(np.int64)
        # left-aligned codes: each starts where the one before it ends
        width = np.left_shift(np.int64(1), self.bits - own)
        ends = np.cumsum(width)
        starts = ends - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (starts >> (self.bits - own)).astype(np.uint64)
        # per window of bits: the id it starts with, and that code's length in the low byte
        self.table = np.ones(1 << self.bits, np.int64)
        self.table[:int(ends[-1]) if len(ids) else 0] = np.repeat(ids << 8 | own, width)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """(bits as bytes, bit offset of every STEP-th id, number of bits)."""
        own = self.lengths[ids].astype(np.int64)
        if not own.all():
            raise ValueError("an id is not in the code")
        codes = self.codes[ids]
        if self.bits <= 16:  # two ids at a time, as one code of up to 32 bits
            if len(ids) % 2:
                own, codes = np.append(own, 0), np.append(codes, np.uint64(0))
            codes = codes[::2] << own[1::2].astype(np.uint64) | codes[1::2]
            own = own[::2] + own[1::2]
        ends = np.cumsum(own)
        total, starts = int(ends[-1]), ends - own
        # a code lies in one or two 32-bit words; bits of different ids never overlap, so sums are exact
        at, left = starts >> 5, 64 - (starts & 31) - own
        value = codes << left.astype(np.uint64)
        n = (total + 31) // 32 + 1
        words = np.bincount(at, (value >> np.uint64(32)).astype(np.float64), n)
        words += np.bincount(at + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
        return words.astype(">u4").tobytes()[:(total + 7) // 8], starts[::STEP // (1 + (self.bits <= 16))], total

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> np.ndarray:
        """Ids of ``blocks`` (bits, checkpoints, number of ids), in order."""
        data = np.frombuffer(b"".join(x for b in blocks for x in (b[0], b"\0\0\0\0")), np.uint8)
        base = np.cumsum([0] + [len(b[0]) + 4 for b in blocks[:-1]]) * 8
        at = np.concatenate([b[1].astype(np.int64) + k for b, k in zip(blocks, base)])
        counts = np.concatenate([np.minimum(STEP, b[2] - np.arange(0, b[2], STEP)) for b in blocks])
        # the 32 bits from every byte on
        words = (data[:-3].astype(np.int64) << 24) | (data[1:-2].astype(np.int64) << 16) | (data[2:-1].astype(np.int64) << 8)
        words |= data[3:]
        mask, last = (1 << self.bits) - 1, (len(data) - 4) * 8
        out = np.zeros((len(at), STEP), np.uint32)
        whole = np.flatnonzero(counts == STEP)
        for lanes, steps in ((whole, STEP), (np.flatnonzero(counts < STEP), int(counts[counts < STEP].max(initial=0)))):
            pos, found = at[lanes], np.zeros((steps, len(lanes)), np.uint32)
            for k in range(steps):
                entry = self.table[words[pos >> 3] >> (32 - self.bits - (pos & 7)) & mask]
                found[k] = entry >> 8
                pos = np.minimum(pos + (entry & 255), last)
            out[lanes, :steps] = found.T
        return out[np.arange(STEP)[None, :] < counts[:, None]]


class Writer:
    """Streams documents' ids to a sink; one block of ids stays in memory."""

    def __init__(self, sink, code: Code):
        self.sink, self.code, self.at = sink, code, 0
        self.docs: list[tuple[int, int, int]] = []
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self._put(HEAD.pack(MAGIC, len(code.lengths), code.bits) + code.lengths.tobytes())

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK:
            self._blocks(BLOCK)

    def _blocks(self, least: int) -> None:
        ids = np.concatenate(self.pending)
        i = 0
        while len(ids) - i >= least and i < len(ids):
            data, marks, bits = self.code.encode(ids[i:i + BLOCK])
            n = len(ids[i:i + BLOCK])
            self._put(BLOCK_HEAD.pack(n, len(marks), bits) + marks.astype("<u4").tobytes() + data)
            i += n
        self.pending, self.held = [ids[i:]], len(ids) - i

    def close(self) -> None:
        if self.held:
            self._blocks(1)
        tail = self.at
        docs = np.array(self.docs, dtype=np.int64).reshape(-1, 3)
        self._put(docs.astype("<i8").tobytes() + END.pack(tail, len(docs), MAGIC))


def documents(ranges) -> np.ndarray:
    """Rows (doc_id, null flag, number of ids) of an open file."""
    tail, n, magic = END.unpack(ranges.read(ranges.size - END.size, END.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    return np.frombuffer(ranges.read(tail, n * 24), "<i8").reshape(-1, 3)


def read_ids(ranges, blocks: int = 8) -> Iterator[np.ndarray]:
    """All ids of an open file in order, ``blocks`` blocks at a time."""
    _, known, _ = HEAD.unpack(ranges.read(0, HEAD.size))
    code = Code(np.frombuffer(ranges.read(HEAD.size, known), np.uint8))
    at, end = HEAD.size + known, END.unpack(ranges.read(ranges.size - END.size, END.size))[0]
    held = []
    while at < end:
        n, marks, bits = BLOCK_HEAD.unpack(ranges.read(at, BLOCK_HEAD.size))
        at += BLOCK_HEAD.size
        raw = ranges.read(at, marks * 4 + (bits + 7) // 8)
        held.append((raw[marks * 4:], np.frombuffer(raw[:marks * 4], "<u4"), n))
        at += len(raw)
        if len(held) == blocks or at >= end:
            yield code.decode(held)
            held = []
