"""Operator 11: vector code compression by member-resident Lloyd rounds.

Vectors of integers are cut into PARTS equal consecutive parts; each part
position has a codebook of at most ENTRIES entries.  A part's code is the
index of its nearest entry.

A table of parts is kept by owners: rows are partitioned by (position, entry,
salt), so an owner holds the members of an entry, or a salt's share of a
popular one.  A round is:

1. Owners compare their resident members with all entries of the position
   (ENTRIES entries of a part's width: bounded, sent with the task) and
   write them again where they are, each marked as staying or moving.
2. Only the parts that change their entry go through a shuffle, to the
   owner of their new entry.  Popular entries have more salts: as many as
   keep an owner at about 1/OWNERS of a partition's even share.
3. Owners sum their resident members; an owner sends one row per entry that
   it holds, and the driver gets ENTRIES x PARTS sums and counts.

Every round is stored in the shared folder before the one before it is
removed, so a lost executor costs part of one round.  All arithmetic is on
integers: in doubles through matrix products where these are exact (below
2^53), else in 64-bit integers.

Defined cases: vectors that are null, empty, or hold null or non-finite
components are dropped, and so are vectors of another length than most have
(of equally frequent lengths the longest); a length that PARTS does not
divide gives the first parts one component more; integers are held within
+-LIMIT (larger components count as LIMIT); rows that share a vec_id are
separate rows, in order of their arrays; a null vec_id comes last; fewer
rows than ENTRIES give as many entries; ties go to the lower index; null
labels are one label; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import discard, join_by_key, materialize, parts, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers' largest absolute value: squared distances of 4096 components stay within 64 bits.
LIMIT = 1 << 24
#: Owners per partition, about, and rows compared at a time.
OWNERS, ROWS = 2, 4096


def _cut(dims: int) -> list[int]:
    """Ends of the parts of ``dims`` components."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(dims), PARTS)]).tolist()]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) within +-LIMIT."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of ``book`` nearest each row of ``x``; ties to the lower index."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, x.shape[1]) < 1 << 53 else np.int64
    book = book.astype(kind)
    norms = (book * book).sum(axis=1)
    place, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        own = x[at:at + ROWS].astype(kind)
        d = norms[None, :] - 2 * (own @ book.T)
        best = d.argmin(axis=1)
        place[at:at + ROWS] = best
        far[at:at + ROWS] = (d[np.arange(len(own)), best] + (own * own).sum(axis=1)).astype(np.int64)
    return place, far


#: A stored part: its row, position, entry (null before the first round), error, components as little-endian 16 or 32 bits.
PART = "rid long, position int, entry int, moves boolean, error long, part binary"
_ARROW = pa.schema([("rid", pa.int64()), ("position", pa.int32()), ("entry", pa.int32()), ("moves", pa.bool_()),
                    ("error", pa.int64()), ("part", pa.binary())])


def _pack(x: np.ndarray) -> pa.Array:
    """Rows of integers as binary values, 16 bits wide where all of them fit."""
    x = np.ascontiguousarray(x, "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4")
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [
        None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x)])


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int32)
    raw = column.to_pylist()
    narrow = np.array([len(r) == 2 * width for r in raw], bool)
    for pick, kind in ((narrow, "<i2"), (~narrow, "<i4")):
        if pick.any():
            out[pick] = np.frombuffer(b"".join(r for r, p in zip(raw, pick) if p), kind).reshape(int(pick.sum()), width)
    return out


def first_entries(vectors: DataFrame) -> np.ndarray:
    """The vectors of the ENTRIES smallest ids, as integers: the codebooks' beginning."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    return integers(np.array([r["embedding"] for r in rows], np.float64))


def cut(numbered: DataFrame, dims: int) -> DataFrame:
    """(rid, embedding) -> a row per part, without an entry."""
    ends = _cut(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                s = b.slice(at, ROWS)
                x = integers(s.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                n = len(x)
                for p in range(PARTS):
                    yield pa.RecordBatch.from_arrays(
                        [s.column("rid"), pa.array(np.full(n, p, np.int32)), pa.nulls(n, pa.int32()),
                         pa.array([True] * n, pa.bool_()), pa.nulls(n, pa.int64()), _pack(x[:, ends[p]:ends[p + 1]])],
                        schema=_ARROW)

    return numbered.select("rid", "embedding").mapInArrow(run, PART)


def assign(members: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Owners compare their members with the entries: the same rows with
    their nearest entry, its squared distance, and whether they move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            position = b.column("position").to_numpy()
            old = b.column("entry").fill_null(-1).to_numpy(zero_copy_only=False)
            for p in np.unique(position):
                own = np.flatnonzero(position == p)
                rows = b.take(pa.array(own))
                entry, error = nearest(_unpack(rows.column("part"), books[p].shape[1]), books[p])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rid"), rows.column("position"), pa.array(entry.astype(np.int32)),
                     pa.array(entry != old[own], pa.bool_()), pa.array(error), rows.column("part")], schema=_ARROW)

    return members.mapInArrow(run, PART)


def migrate(assigned: DataFrame) -> DataFrame:
    """The moving parts of the stored round, at the owners of their new entries."""
    n = parts(assigned.sparkSession)
    counts = assigned.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n")).collect()
    share = max(1.0, sum(r["n"] for r in counts) / (n * OWNERS))
    # a salt count per entry with more rows than an owner's share: PARTS * ENTRIES at most
    many = [x for r in counts if r["n"] > share for x in (F.lit(r["position"] * ENTRIES + r["entry"]), F.lit(-int(-r["n"] // share)))]
    salts = F.lit(1)
    if many:
        salts = F.coalesce(F.try_element_at(F.create_map(*many), F.col("position") * ENTRIES + F.col("entry")), F.lit(1))
    salt = F.pmod(F.xxhash64("rid"), salts)
    return (assigned.where("moves").withColumn("salt", salt).repartition(n, "position", "entry", "salt")
            .sortWithinPartitions("position", "entry", "salt").drop("salt"))


def sums(members: DataFrame, widths: list[int]) -> list[tuple[int, int, int, list[int]]]:
    """(position, entry, rows, sum per component): owners' sums of their resident members."""
    schema = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((ENTRIES, 1 + w), np.int64) for w in widths]  # count, then components
        for b in batches:
            position, entry = b.column("position").to_numpy(), b.column("entry").to_numpy()
            for p in np.unique(position):
                own = np.flatnonzero(position == p)
                x, e = _unpack(b.column("part").take(pa.array(own)), widths[p]), entry[own]
                order = np.argsort(e, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(e[order]) != 0))
                total[p][e[order][at], 1:] += np.add.reduceat(x[order].astype(np.int64), at)
                total[p][:, 0] += np.bincount(e, minlength=ENTRIES)
        found = [(p, int(e)) for p in range(len(widths)) for e in np.flatnonzero(total[p][:, 0])]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()),
                 pa.array([int(total[p][e, 0]) for p, e in found], pa.int64()),
                 pa.array([total[p][e, 1:].tolist() for p, e in found], pa.list_(pa.int64()))], schema=schema)

    rows = members.select("position", "entry", "part").mapInArrow(run, "position int, entry int, n long, s array<long>")
    each = [F.sum(F.try_element_at("s", F.lit(i + 1))).alias(f"s{i}") for i in range(max(widths))]
    return [(r["position"], r["entry"], r["n"], [r[f"s{i}"] for i in range(widths[r["position"]])])
            for r in rows.groupBy("position", "entry").agg(F.sum("n").alias("n"), *each).collect()]


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``vectors`` (vec_id, embedding, label) -> (vec_id, label, code, error), and the codebooks."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.select("vec_id", "embedding", "label").where(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    lengths = v.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("dims")).limit(1).collect()
    if not lengths:
        none = v.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none, [np.zeros((0, 0), np.int32)] * PARTS
    dims = lengths[0]["dims"]
    ends = _cut(dims)
    widths = [e - s for s, e in zip(ends, ends[1:])]
    numbered = materialize(v.where(F.size("embedding") == dims).withColumn("rid", F.monotonically_increasing_id()))
    begin = first_entries(numbered)
    books = [begin[:, s:e].astype(np.int64) for s, e in zip(ends, ends[1:])]
    members, old = cut(numbered, dims), []
    for _ in range(rounds):
        assigned = materialize(assign(members, books))
        came = materialize(migrate(assigned))
        members = assigned.where("NOT moves").unionAll(came)
        for p, e, n, s in sums(members, widths):
            books[p][e] = [x // n for x in s]
        discard(*old)
        old = [assigned, came]
    last = materialize(assign(members, books).select("rid", "position", "entry", "error"))
    discard(*old)
    # one row per vector again: its own row and those of its parts meet by rid
    code = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = last.select("rid", F.lit(False).alias("own"), null(dict(numbered.dtypes)["vec_id"]).alias("vec_id"),
                       null(dict(numbered.dtypes)["label"]).alias("label"), "position", code.alias("code"), "error")
    rows = rows.unionAll(numbered.select("rid", F.lit(True), "vec_id", "label", null("int"), null("string"), null("long")))
    out = rows.groupBy("rid").agg(
        F.max(F.when(F.col("own"), F.struct("vec_id", "label"))).alias("own"), F.sum("error").alias("error"),
        *[F.max(F.when(F.col("position") == p, F.col("code"))).alias(f"c{p}") for p in range(PARTS)])
    return out.select("own.vec_id", "own.label", F.concat(*[f"c{p}" for p in range(PARTS)]).alias("code"), "error"), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: the error summed over rows of an equal label, nulls together."""
    c = materialize(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    total = c.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    return join_by_key(c, total, "key", ["label_error"], "rows", c.count(), ["vec_id", "code"]).drop("key")


def q_vector_codes(spark, sf_dir):
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error",
                                          F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds unrolled, in exact doubles."""
    near = lambda book: f"""(  -- position, entry, distance by vec_id
  SELECT vec_id, label, p, x, m.e AS e, m.d AS d FROM (
    SELECT a.vec_id, a.label, a.p, any_value(a.x) AS x,
      min({{'d': a.xx + b.yy - 2 * list_inner_product(a.x, b.y), 'e': b.e}}) AS m
    FROM parts a JOIN (SELECT *, list_inner_product(y, y) AS yy FROM {book}) b ON a.p = b.p GROUP BY 1, 2, 3))"""  # noqa: E731
    out = [f"""v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (
  SELECT vec_id, label, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) AS r(p))),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES})"""]
    for k in range(ROUNDS):
        out.append(f"""a{k} AS MATERIALIZED {near(f"b{k}")},
s{k} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS y FROM (
  SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (
    SELECT p, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.y, b.y) AS y FROM b{k} b LEFT JOIN s{k} s ON b.p = s.p AND b.e = s.e)""")
    return "WITH " + ",\n".join(out) + f""",
a AS MATERIALIZED {near(f"b{ROUNDS}")},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
  sum(d)::BIGINT AS error FROM a GROUP BY vec_id),
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (
  SELECT p, e, array_to_string(list_transform(y, lambda q: q::BIGINT::VARCHAR), ',') AS t FROM b{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"""


SQL = _sql()
