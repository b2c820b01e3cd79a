"""Operator 10: near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors have cosine c where their squared distance is 2 - 2c.  The
vectors are rotated (a fixed random rotation, so that no block is special)
and split into blocks of low dimension.  If two vectors are within the
total budget of squared distance, then in at least one block they are
within that block's share, in proportion to its dimensions.  So the
candidates are the union of the blocks' range joins, and the union is
verified exactly, in double precision, on the original vectors.

A block's range join puts vectors into grid cells on the block's first two
coordinates, two radii wide; a vector is at home in its cell and a guest in
those later neighbour cells that its ball reaches.  Cells are joined in
tiles of at most TILE rows a side: matrix products of the block's
coordinates find pairs within the share (with slack for rounding), which
are verified right there.  A pair that qualifies in several blocks belongs
to the first of them.  A tile returns per vector the number of links, and
the links' spanning forest; pairs never leave the tile.

Equal vectors are one vector with a count.  Rows that share a vec_id are
one vector, the smallest in array order.

Defined cases: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing and are components of their own;
vectors of other dimensions are never linked; a null vec_id has component
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import join_by_key, materialize, table
from claimledger.llm.components import components, local_labels

BLOCK_DIMS, TILE, SLACK = 16, 16384, 1e-5
#: Rows of a tile's left side and candidate pairs looked at together: bounds of a task's memory, also in dense groups.
ROWS, PAIRS = 256, 1 << 15


class Space:
    """Rotation, blocks, shares and cells for vectors of one dimension."""

    def __init__(self, dims: int, threshold: float):
        self.dims = dims
        self.rotation = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]
        self.blocks = np.array_split(np.arange(dims), max(1, dims // BLOCK_DIMS))
        self.budget = 2 - 2 * threshold
        self.shares = [self.budget * len(b) / dims for b in self.blocks]

    def rotate(self, units: np.ndarray) -> np.ndarray:
        return units @ self.rotation

    def cells(self, rotated: np.ndarray, block: int):
        """(row, cell, guest) for all rows: home cells and visited ones."""
        radius = math.sqrt(self.shares[block]) + SLACK
        axes = self.blocks[block][:2]
        place = rotated[:, axes] / (2 * radius)
        home = np.floor(place).astype(np.int64)
        gap = place - home  # in units of the cell's width; the radius is one half
        rows = np.arange(len(rotated))
        yield rows, home, False
        steps = [(0, 1), (1, -1), (1, 0), (1, 1)] if len(axes) == 2 else [(1,)]
        for step in steps:
            away = [np.zeros(len(rows)) if s == 0 else 1 - gap[:, k] if s > 0 else gap[:, k] for k, s in enumerate(step)]
            near = sum(x * x for x in away) <= 0.25 + 1e-9
            yield rows[near], home[near] + np.array(step), True


def units(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


CELL = ["dims", "block", "x", "y"]
PLACED = "dims int, block int, x long, y long, guest boolean, rep long, n long, vec binary"


def place(reps: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, Space] = {}
        for b in batches:
            ids, counts = b.column("rep").to_numpy(), b.column("n").to_numpy()
            lists = b.column("embedding").to_pylist()
            sizes = np.array([len(v) for v in lists])
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                raw = np.array([lists[i] for i in own], dtype=np.float64)
                space = spaces.setdefault(int(dims), Space(int(dims), threshold))
                rotated = space.rotate(units(raw))
                vecs = [v.tobytes() for v in raw.astype("<f4")] if (raw.astype(np.float32) == raw).all() \
                    else [v.tobytes() for v in raw]
                for block in range(len(space.blocks)):
                    for rows, cell, guest in space.cells(rotated, block):
                        n = len(rows)
                        if n:
                            yield pa.RecordBatch.from_pydict({
                                "dims": pa.array([int(dims)] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()),
                                "x": cell[:, 0], "y": cell[:, 1] if cell.shape[1] > 1 else np.zeros(n, np.int64),
                                "guest": pa.array([guest] * n), "rep": ids[own[rows]], "n": counts[own[rows]],
                                "vec": pa.array([vecs[i] for i in rows], pa.binary())})

    return reps.select("rep", "n", "embedding").mapInArrow(run, PLACED)


def tiles(placed: DataFrame) -> DataFrame:
    """Rows of every cell, once per tile: home against home, guests against
    home.  There are few cells (a vector's coordinates are within one of
    zero), so the table of their sizes is bounded and broadcast."""
    sizes = placed.groupBy(*CELL).agg(
        F.ceil(F.count_if(~F.col("guest")) / TILE).alias("homes"), F.ceil(F.count_if("guest") / TILE).alias("guests"))
    p = placed.join(F.broadcast(sizes), CELL).where("homes > 0")
    p = p.withColumn("i", F.pmod(F.xxhash64("rep"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    tile = lambda kind, a, b, left: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"),
                                             left.alias("left"))
    i = F.col("i")
    own = F.transform(upto(F.col("homes")), lambda j: tile("home", F.least(i, j), F.greatest(i, j), i <= j))
    host = F.when(F.col("guests") > 0, F.transform(upto(F.col("guests")), lambda k: tile("guest", k, i, F.lit(False))))
    host = F.coalesce(host, F.expr("array()").cast("array<struct<kind:string,a:bigint,b:bigint,left:boolean>>"))
    visit = F.transform(upto(F.col("homes")), lambda j: tile("guest", i, j, F.lit(True)))
    p = p.withColumn("tile", F.explode(F.when(F.col("guest"), visit).otherwise(F.concat(own, host))))
    return p.select(*CELL, "tile.kind", "tile.a", "tile.b", "tile.left", "rep", "n", "vec")


def _pairs(space: Space, block: int, ua, ub, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the threshold that belong to this block."""
    ra, rb = space.rotate(ua), space.rotate(ub)
    a32, b32 = ra[:, space.blocks[block]].astype(np.float32), rb[:, space.blocks[block]].astype(np.float32)
    na, nb = (a32 * a32).sum(axis=1), (b32 * b32).sum(axis=1)
    for at in range(0, len(ua), ROWS):
        d = na[at:at + ROWS, None] + nb[None, :] - 2 * (a32[at:at + ROWS] @ b32.T)
        i, j = np.nonzero(d <= space.shares[block] + SLACK)
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for k in range(0, len(i), PAIRS):
            x, y = i[k:k + PAIRS], j[k:k + PAIRS]
            link = np.einsum("ij,ij->i", ua[x], ub[y]) >= 1 - space.budget / 2
            x, y = x[link], y[link]
            gap = (ra[x] - rb[y]) ** 2
            near = [gap[:, space.blocks[o]].sum(axis=1) <= space.shares[o] + 1e-9 for o in range(block + 1)]
            first = near[block] & ~np.any(near[:block], axis=0) if block else near[block]
            yield x[first], y[first]


def links(tiled: DataFrame, threshold: float) -> DataFrame:
    """(node, n, other): link counts (other null) and forest edges (n null)."""
    def solve(at, rows):
        dims, block, _, _, kind, one, two = at
        space = spaces.setdefault(dims, Space(dims, threshold))
        left = np.concatenate([r[0] for r in rows])
        rep, n = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        raw = np.concatenate([r[3] for r in rows])
        u = units(raw)
        same = kind == "home" and one == two
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        total, every = np.zeros(len(rep), np.int64), np.arange(len(rep))
        label = every
        for x, y in _pairs(space, block, u[a], u[b], same):
            x, y = a[x], b[y]
            total += np.bincount(x, n[y], len(rep)).astype(np.int64) + np.bincount(y, n[x], len(rep)).astype(np.int64)
            if len(x):  # links so far are kept as their labels only
                label = local_labels(len(rep), np.concatenate([x, every]), np.concatenate([y, label]))
        some, child = np.flatnonzero(total), np.flatnonzero(label != every)
        none = np.zeros(len(child), np.int64)
        edge = np.arange(len(some) + len(child)) >= len(some)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rep[some], rep[child]])), pa.array(np.concatenate([total[some], none]), mask=edge),
             pa.array(np.concatenate([total[some], rep[label[child]]]), mask=~edge)], names=["node", "n", "other"])

    spaces: dict[int, Space] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, at, rows = [*CELL, "kind", "a", "b"], None, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in keys]
            ks = list(zip(*cols))
            cuts = [0, *[i for i in range(1, len(ks)) if ks[i] != ks[i - 1]], len(ks)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if ks[s] != at and rows:
                    yield solve(at, rows)
                    rows = []
                at, part = ks[s], batch.slice(s, e - s)
                vecs = np.array([np.frombuffer(v, "<f4" if len(v) == 4 * at[0] else "<f8")
                                 for v in part.column("vec").to_pylist()], dtype=np.float64)
                rows.append((part.column("left").to_numpy(zero_copy_only=False), part.column("rep").to_numpy(),
                             part.column("n").to_numpy(), vecs))
        if rows:
            yield solve(at, rows)

    keys = [*CELL, "kind", "a", "b"]
    return (tiled.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "node long, n long, other long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    v = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    v = v.withColumn("key", F.when(good, F.md5(F.col("embedding").cast("string").cast("binary"))))
    v = materialize(v)
    valid = v.where("key IS NOT NULL")
    reps = materialize(valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                                F.first("embedding").alias("embedding")))
    found = materialize(links(tiles(place(reps, threshold)), threshold))
    comps = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    # per distinct vector: links to others, counted with their copies, and the component
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("others"))
    answer = (reps.select("key", "rep", "n").join(counts, F.col("rep") == F.col("node"), "left").drop("node")
              .join(comps, F.col("rep") == F.col("node"), "left")
              .select("key", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    total = valid.count()
    out = join_by_key(v.select("vec_id", F.coalesce("key", F.concat(F.lit("-"), F.col("vec_id").cast("string")),
                                                    F.lit("-")).alias("key")),
                      materialize(answer), "key", ["n_links", "component_id"], "n", total, ["vec_id"])
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def q_embeddings(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""
