"""Raw files read by byte ranges inside tasks: hash trees (A8) and the shape
of every single file (A2).

Spark lists the files; the listing's rows, not the bytes, are dealt to tasks,
and each task opens its files itself and reads them in pieces of fixed size.
So a file may be far larger than a value of a row, and one large file is
hashed by many tasks.  Files of schemes that pyarrow can't open are refused
with an error (``byte_fingerprint`` reads those as values).
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a leaf, children of a node, and bytes held at once while reading.
BLOCK = 64 << 20
FAN = 256
PIECE = 4 << 20
#: Bytes of a text file's head that its columns and types are read from.
HEAD = 1 << 20

# Schemes that tasks open themselves.
SCHEMES = ["", "file", "hdfs", "viewfs", "s3", "s3a", "gs", "abfs", "abfss"]


def scheme_of(path: str) -> str:
    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", path)
    return found.group(1).lower() if found else ""


def open_file(path: str):
    """Random access to a file that Spark's listing names (not URL-encoded)."""
    from urllib.parse import quote

    from pyarrow import fs
    scheme = scheme_of(path)
    if scheme not in SCHEMES:
        raise ValueError(f"files of scheme {scheme!r} can't be read by ranges")
    if scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^(file:)?/+", "/", path))
    system, inner = fs.FileSystem.from_uri(quote(re.sub(r"^s3a:", "s3:", path), safe=":/@"))
    return system.open_input_file(inner)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files with at least one byte; none is opened."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", "length"))


def _digest(path: str, start: int, length: int, prefix: bytes = b"") -> str:
    """Hash of a range, in memory of one piece.  A file that became shorter
    since it was listed is an error."""
    h = hashlib.sha256(prefix)
    with open_file(path) as f:
        at, end = start, start + length
        while at < end:
            piece = f.read_at(min(PIECE, end - at), at)
            if not piece:
                raise OSError(f"{path} ends at byte {at}, {end} were listed")
            h.update(piece)
            at += len(piece)
    return h.hexdigest()


def _dealt(files: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows dealt to a number of tasks that grows with the bytes (about 1 GB
    each); a stated number isn't merged again for the rows being small."""
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, min(100_000, size >> 30))
    return files.repartition(tasks, *keys)


def whole_hashes(files: DataFrame) -> DataFrame:
    """(path, length) -> (path, length, sha256): one pass a file of constant
    memory, equal to ``sha256sum``."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [n], "sha256": [_digest(path, 0, n)]})

    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return _dealt(files, size, "path").select("path", "length").mapInArrow(
        hashed, "path string, length long, sha256 string")


def block_hashes(spark: SparkSession, root: str, block: int = BLOCK) -> DataFrame:
    """(path, block, bytes, sha256): one leaf per ``block`` bytes of each file
    under ``root``, the last one shorter.  A leaf is the hash of a zero byte
    and the bytes.  Files without a byte have no leaf."""
    files = listing(spark, root)
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("block"),
                       "length").where("length > 0")
    cut = cut.select("path", "block", F.least(F.lit(block), F.col("length") - F.col("block") * block).alias("bytes"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, i, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                yield pa.RecordBatch.from_pydict({"path": [path], "block": [i], "bytes": [n],
                                                  "sha256": [_digest(path, i * block, n, b"\0")]})

    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return _dealt(cut, size, "path", "block").mapInArrow(hashed, "path string, block long, bytes long, sha256 string")


def tree_roots(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """Leaves -> (path, n_blocks, bytes, sha256): the root of each file's hash
    tree.  A node hashes a one byte and its at most ``fan`` children's hashes
    in order; a single leaf is its own root.  As many rounds of a keyed
    aggregate as the largest file needs (two for 4 TB), so no task holds more
    than ``fan`` hashes of a node.  ``blocks`` is read twice: store it."""
    totals = blocks.groupBy("path").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("bytes").alias("bytes"))
    level = blocks.select("path", F.col("block").alias("i"), F.col("sha256").alias("h"))
    most = totals.agg(F.coalesce(F.max("n_blocks"), F.lit(0))).first()[0]
    while most > 1:
        level = level.groupBy("path", F.floor(F.col("i") / fan).alias("i")).agg(
            F.array_sort(F.collect_list(F.struct("i", "h"))).alias("c"))
        joined = F.array_join(F.transform("c", lambda x: x["h"]), "")
        level = level.select("path", "i", F.when(F.size("c") == 1, F.col("c")[0]["h"]).otherwise(
            F.sha2(F.unhex(F.concat(F.lit("01"), joined)), 256)).alias("h"))
        most = -(-most // fan)
    return totals.join(level.select("path", F.col("h").alias("sha256")), "path")


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, block, change): leaves 'added', 'removed' or 'changed' between
    two tables of leaves with the same block size; equal leaves give no row."""
    a, b = (x.select("path", "block", F.col("sha256").alias(n)) for x, n in ((before, "old"), (after, "new")))
    change = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    return a.join(b, ["path", "block"], "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(
        "path", "block", change.alias("change"))


# ---------------------------------------------------------------- shapes of single files

# The order of types, each holding the ones before it.
LATTICE = ["null", "boolean", "integer", "double", "text"]


def _value_type(x) -> str:
    if x is None or x == "":
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, int):
        return "integer"
    if isinstance(x, float):
        return "double"
    if not isinstance(x, str):
        return "text"
    if re.fullmatch(r"[+-]?\d{1,18}", x):
        return "integer"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x):
        return "double"
    return "boolean" if x.lower() in ("true", "false") else "text"


def _join_types(a: str, b: str) -> str:
    if a == b or "null" in (a, b):
        return a if b == "null" else b
    return "text" if "boolean" in (a, b) else max(a, b, key=LATTICE.index)


def _of_records(records) -> list[tuple[str, str]]:
    types: dict[str, str] = {}
    for r in records:
        for k, x in r.items():
            types[k] = _join_types(types.get(k, "null"), _value_type(x))
    return list(types.items())


def _of_csv(head: str, cut: bool) -> list[tuple[str, str]]:
    rows = list(csv.reader(io.StringIO(head)))
    if cut and len(rows) > 1:
        rows.pop()  # the head may end inside a record
    if not rows:
        return []
    wide = [n if n else f"_c{i}" for i, n in enumerate(rows[0])]
    types = ["null"] * len(wide)
    for row in rows[1:]:
        for i, x in enumerate(row[:len(wide)]):
            types[i] = _join_types(types[i], _value_type(x))
    return list(zip(wide, types))


def _of_json(head: str, cut: bool) -> list[tuple[str, str]]:
    """Records of a list, of lines, or one object; of a cut head as many as
    it holds whole."""
    decoder, at, records = json.JSONDecoder(), 0, []
    skip = re.compile(r"[\s,]*")
    text = head.lstrip("﻿ \t\r\n")
    at = 1 if text.startswith("[") else 0
    while True:
        at = skip.match(text, at).end()
        if at >= len(text) or text[at] == "]":
            break
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            if cut and records:
                break
            raise
        if not isinstance(value, dict):
            raise ValueError("a record is not an object")
        records.append(value)
    return _of_records(records)


def _shape(path: str, fmt: str, head: int) -> tuple[int, list[tuple[str, str]]]:
    with open_file(path) as f:
        size = f.size()
        if size == 0:
            return 0, []
        if fmt == "parquet":
            import pyarrow.parquet as pq
            return size, [(c.name, str(c.type)) for c in pq.ParquetFile(f).schema_arrow]
        text = f.read_at(min(size, head), 0).decode("utf-8", errors="replace" if size <= head else "ignore")
    return size, (_of_csv if fmt == "csv" else _of_json)(text, size > head)


def file_shapes(spark: SparkSession, root: str, head: int = HEAD) -> DataFrame:
    """(path, format, bytes, n_cols, columns array<struct<name, type>>, error):
    the columns of every data file under ``root``, each from the file itself:
    a Parquet file's footer, the first ``head`` bytes of a CSV or JSON file.
    CSV's and JSON's types are null, boolean, integer, double or text over the
    records of that head; fields of all its JSON records count.

    A file without a byte has no columns and no error; one that can't be read
    has an error and NULL columns, and doesn't stop the others.  Dotfiles and
    documentation are skipped as in ``scan_tree``.
    """
    from urllib.parse import unquote

    from claimledger.sources.scan import FORMATS, SKIP_SUFFIXES
    names = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)).inputFiles()
    found = []
    for uri in names:
        name = unquote(uri).rsplit("/", 1)[-1].lower()
        fmt = FORMATS.get("." + name.rsplit(".", 1)[-1])
        if fmt and not name.startswith(".") and not name.endswith(tuple(SKIP_SUFFIXES)):
            found.append((unquote(uri), fmt))
    out = "path string, format string, bytes long, n_cols int, columns array<struct<name:string,type:string>>, error string"
    if not found:
        return spark.createDataFrame([], out)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("format", pa.string()), ("bytes", pa.int64()), ("n_cols", pa.int32()),
                          ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
                          ("error", pa.string())])
        for b in batches:
            for path, fmt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = {"path": path, "format": fmt, "bytes": None, "n_cols": None, "columns": None, "error": None}
                try:
                    size, cols = _shape(path, fmt, head)
                    row |= {"bytes": size, "n_cols": len(cols), "columns": [{"name": n, "type": t} for n, t in cols]}
                except (OSError, ValueError, csv.Error, pa.ArrowException) as e:
                    row["error"] = f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"
                yield pa.RecordBatch.from_pylist([row], schema=kind)

    files = spark.createDataFrame(found, "path string, format string")
    tasks = max(spark.sparkContext.defaultParallelism, min(100_000, len(found) // 256))
    return files.repartition(tasks, "path").mapInArrow(shapes, out)
