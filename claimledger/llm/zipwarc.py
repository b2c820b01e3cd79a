"""Operator 4: WARC archives packaged in ZIP files, read by ranges.

A package is a ZIP file with two stored (uncompressed) members: the archive
``archive/data.warc.gz``, one gzip member per record, and the index
``indexes/index.tsv`` with a line per record (offset and length within the
archive member, record type, page).  The reader never extracts a package:
it reads the end of the file, follows the ZIP64 locator where there is one,
parses the central directory, locates the data of the two members behind
their local headers, reads the index, and then range-reads record by record.

The writer puts equal payloads into one response record and revisit records
that refer to it.  Which page of a group is the response needs one
aggregate on the payload digest; digests with many pages get the
answer by broadcast, all others by a shuffle.

Defined cases: null html is an empty payload; payloads under 100 bytes are
all responses; repeated rows with the smallest page_id of their payload are
all responses; null page_ids come last in a group and read back as null; an
empty table gives no package and no row; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import join_by_key, materialize, parts, scratch, table, text_slices
from claimledger.llm.files import Ranges, committed, make_dir

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: A package is closed at this size, and the task goes on with a new one.
PACKAGE_BYTES = 256 << 20

# Signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
LOCAL_HEADER = struct.Struct("<4s5H3I2H")
CENTRAL_HEADER = struct.Struct("<4s6H3I5H2I")
END_RECORD = struct.Struct("<4s4H2IH")
END64_RECORD = struct.Struct("<4sQ2H2I4Q")
LOCATOR64_RECORD = struct.Struct("<4sIQI")
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


# ---------------------------------------------------------------- packages

class PackageWriter:
    """Writes one package to a sink, a record at a time (only the index
    lines stay in memory).  Sizes are not known when a local header is
    written, so it announces a data descriptor; all 64-bit fields go to
    ZIP64 extras, used at any size."""

    def __init__(self, sink):
        self.sink, self.at, self.members, self.index = sink, 0, [], []
        self._begin("archive/data.warc.gz")

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append({"name": raw, "offset": self.at, "crc": 0})
        extra = struct.pack("<2H2Q", 1, 16, 0, 0)
        self._put(LOCAL_HEADER.pack(LOCAL, 45, 0x0808, 0, 0, 33, 0, MAX32, MAX32, len(raw), len(extra)) + raw + extra)
        self.members[-1]["data"] = self.at

    def _data(self, data: bytes) -> None:
        self.members[-1]["crc"] = zlib.crc32(data, self.members[-1]["crc"])
        self._put(data)

    def _end(self) -> None:
        m = self.members[-1]
        m["size"] = self.at - m["data"]
        self._put(struct.pack("<4sI2Q", b"PK\x07\x08", m["crc"], m["size"], m["size"]))

    def add(self, record: bytes, line: str) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.index.append(f"{self.at - self.members[-1]['data']}\t{len(packed)}\t{line}\n")
        self._data(packed)

    def close(self) -> None:
        self._end()
        self._begin("indexes/index.tsv")
        self._data("".join(self.index).encode())
        self._end()
        start = self.at
        for m in self.members:
            extra = struct.pack("<2H3Q", 1, 24, m["size"], m["size"], m["offset"])
            self._put(CENTRAL_HEADER.pack(CENTRAL, 45, 45, 0x0808, 0, 0, 33, m["crc"], MAX32, MAX32, len(m["name"]),
                                          len(extra), 0, 0, 0, 0, MAX32) + m["name"] + extra)
        size, at64 = self.at - start, self.at
        n = len(self.members)
        self._put(END64_RECORD.pack(END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR64_RECORD.pack(LOCATOR64, 0, at64, 1))
        self._put(END_RECORD.pack(END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))


def directory(f: Ranges) -> dict[str, dict]:
    """Members of a package from its central directory: name -> offset of
    the local header, method, sizes, crc."""
    tail_at = max(0, f.size - END_RECORD.size - MAX16)
    tail = f.read(tail_at, f.size - tail_at)
    i = tail.rfind(END)
    while i >= 0:
        if len(tail) - i >= END_RECORD.size:
            _, _, _, _, count, size, start, note = END_RECORD.unpack_from(tail, i)
            if i + END_RECORD.size + note == len(tail):
                break
        i = tail.rfind(END, 0, i)
    if i < 0:
        raise ValueError("no end of central directory")
    j = tail_at + i - LOCATOR64_RECORD.size
    if j >= 0 and MAX32 in (size, start) or count == MAX16:
        sig, _, at64, _ = LOCATOR64_RECORD.unpack(f.read(j, LOCATOR64_RECORD.size))
        if sig == LOCATOR64:
            sig, _, _, _, _, _, _, count, size, start = END64_RECORD.unpack(f.read(at64, END64_RECORD.size))
            if sig != END64:
                raise ValueError("broken ZIP64 end record")
    raw, out, at = f.read(start, size), {}, 0
    for _ in range(count):
        (sig, _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_note, _, _, _,
         offset) = CENTRAL_HEADER.unpack_from(raw, at)
        if sig != CENTRAL:
            raise ValueError("broken central directory")
        at += CENTRAL_HEADER.size
        name, extra = raw[at:at + n_name].decode(), raw[at + n_name:at + n_name + n_extra]
        at += n_name + n_extra + n_note
        k = 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<2H", extra, k)
            if tag == 1:  # 64-bit values, only of the fields that overflow, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = next(wide) if plain == MAX32 else plain
                packed = next(wide) if packed == MAX32 else packed
                offset = next(wide) if offset == MAX32 else offset
            k += 4 + n
        out[name] = {"method": method, "offset": offset, "size": packed, "plain": plain, "crc": crc}
    return out


def data_start(f: Ranges, member: dict) -> int:
    """Offset of a stored member's first byte in the package."""
    if member["method"] != 0:
        raise ValueError("member is not stored: its ranges can't be read")
    head = LOCAL_HEADER.unpack(f.read(member["offset"], LOCAL_HEADER.size))
    if head[0] != LOCAL:
        raise ValueError("broken local header")
    return member["offset"] + LOCAL_HEADER.size + head[9] + head[10]


def index_lines(f: Ranges) -> Iterator[tuple[int, int, list[str]]]:
    """(offset in the package, length, further fields) per record."""
    members = directory(f)
    archive, index = members["archive/data.warc.gz"], members["indexes/index.tsv"]
    base = data_start(f, archive)
    raw = f.read(data_start(f, index), index["size"])
    if zlib.crc32(raw) != index["crc"]:
        raise ValueError("broken index")
    for line in raw.decode().splitlines():
        offset, length, *rest = line.split("\t")
        yield base + int(offset), int(length), rest


def records(f: Ranges) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC headers, block) per record, one range read each."""
    for offset, length, _ in index_lines(f):
        head, _, rest = gzip.decompress(f.read(offset, length)).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines)
        yield headers, rest[:int(headers["Content-Length"])]


# ---------------------------------------------------------------- operator

def record_types(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, payload_bytes, payload_digest, record_type
    and refers_to."""
    p = pages.withColumn("payload", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8"))
    p = p.withColumn("payload_bytes", F.length("payload").cast("long"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256)).drop("html")
    long = p.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    groups = (long.groupBy("payload_digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    groups = materialize(groups)
    total = groups.agg(F.sum("n")).first()[0] or 0
    p = join_by_key(p, groups, "payload_digest", ["first_id"], "n", total, ["page_id", "url"])
    again = F.col("first_id").isNotNull() & ~F.coalesce(F.col("first_id") == F.col("page_id"), F.lit(False))
    return (p.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id"))


def _record(row: dict) -> bytes:
    payload = b"" if row["record_type"] == "revisit" else row["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}",
             f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
             f"WARC-Target-URI: {' '.join((row['url'] or '').split())}",
             f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
             f"X-Payload-Length: {row['payload_bytes']}"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


COLUMNS = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def write_packages(typed: DataFrame, folder: str) -> DataFrame:
    """Write ``typed`` (see record_types) to packages in ``folder``; returns
    the manifest (path, records, bytes), one row per package.  The manifest
    must be stored before it is used: the job that fills it writes the files."""
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for part in text_slices(b, "payload") for row in part.to_pylist())
        row, k = next(rows, None), 0
        while row is not None:
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}-{k}.wacz"
            k += 1
            with committed(name) as sink:
                w, n = PackageWriter(sink), 0
                while row is not None and w.at < PACKAGE_BYTES:
                    w.add(_record(row), f"{row['record_type']}\t{'' if row['page_id'] is None else row['page_id']}")
                    row, n = next(rows, None), n + 1
                w.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [w.at]})

    return typed.select(*COLUMNS).mapInArrow(write, "path string, records long, bytes long")


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def read_packages(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages that ``manifest`` names.  A response's
    size and digest are those of the bytes read; a revisit has them from
    its headers."""
    keep = payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Ranges(path) as f:
                    out, size = [], 0
                    for h, body in records(f):
                        revisit = h["WARC-Type"] == "revisit"
                        out.append({
                            "page_id": _number(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"],
                            "payload_bytes": int(h["X-Payload-Length"]) if revisit else len(body),
                            "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha256:") if revisit
                            else hashlib.sha256(body).hexdigest(),
                            "record_type": h["WARC-Type"], "refers_to": _number(h.get("WARC-Refers-To")),
                            "payload": body if keep and not revisit else None})
                        size += len(body) * keep + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    n = max(1, parts(manifest.sparkSession))
    return manifest.select("path").repartition(n, "path").mapInArrow(read, SCHEMA)


ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                   ("payload", pa.binary())])


def q_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = materialize(write_packages(record_types(pages), scratch(spark, "wacz")))
    return read_packages(manifest, payloads=False).drop("url", "payload")


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND first_id <> page_id THEN first_id END AS refers_to
FROM g"""
