"""Operator 2: n-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its k-word shingles.  Two sets of at least a
similarity t share T = ceil(t * n) shingles of each of them (n: its size),
so among the n - T + 1 rarest shingles of either, one is shared: only the
short inverted lists must be merged to find candidates, the long ones are
probed later.

1. One pass over the texts gives per document n and the key of its set, and
   postings (shingle, key) for the part of the hash space that comes first
   in the global order (REGION; more where a set is unlucky).  Equal sets
   are one key.
2. Frequencies over all postings order the shingles, rare ones first.  Shingles of one key need no list; of the others each key
   keeps those among its n - T + 1 first.
3. Keys that share a list are candidates of each other: their groups are
   the components of stars over the lists.  No pairs are made.
4. A second pass over the texts brings the sets of candidate keys (a bitmap
   of bounded size skips the others) to their group.  Large groups are cut
   by size band and hash into tiles; a tile is searched by DivideSkip: for
   each set merge its short lists in the tile's index, keep those that can
   still reach T, and binary-probe its long lists for them.  All
   pairs are compared, so that every link is counted; only a caller that
   wants classes alone (the pipeline) skips sets that are already connected.  A tile keeps counts and a
   forest, not links; every pair of keys meets in one tile.
5. Components of the links give the classes; a document's number of links
   is the sum of its key's counts over the tiles.

Defined cases: null, empty or blank text has no shingle, links with nothing
and is its own class; a very long text is cut into slices of words for
hashing, and all its shingles count; a text of fewer than k words is one shingle; rows
that share a doc_id are one node; a null doc_id can be in no class but its
set's; ties are broken by hash; an empty table gives an empty result; extra
columns are ignored.  Links are counted between rows: a link to a set is one
to each row that has it, and rows of equal sets link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimledger.llm import shingles
from claimledger.llm.common import join_by_key, lean, materialize, release, table, text_slices
from claimledger.llm.components import components

#: Shingles of a tile's side; bits of the bitmap of candidate keys.
TILE, BITS = 1 << 18, 26
#: DivideSkip's weight of a probe against a merge.
PROBE = 0.1


def _region(t: float) -> int:
    """How many of 1024 parts of the hash space come first: half as much
    again as the prefix needs."""
    return min(1024, math.ceil(1024 * (1.5 * (1 - t) + 0.05)))


def _keys(found: list[np.ndarray]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in found]


def scan(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows of documents (doc_id, n, key, r) and of postings (shingle, key);
    r is the number of shingles in the region."""
    region = np.uint64(_region(num / den))
    names = ["doc_id", "n", "r", "shingle", "key"]
    types = [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                found = shingles.sets(part.column("text"), k)
                keys, rs, lists, owners = _keys(found), [], [], []
                for s, key in zip(found, keys):
                    first = s[(s & np.uint64(1023)) < region]
                    rs.append(len(first))
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                    need = len(s) - -(-num * len(s) // den) + 1
                    if len(first) < need:
                        rest = s[(s & np.uint64(1023)) >= region]
                        first = np.concatenate([first, rest[:need - len(first)]])
                    lists.append(first)
                    owners.append(np.full(len(first), key, np.int64))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in found], pa.int64()),
                     pa.array(rs, pa.int64()), pa.nulls(n, pa.int64()), pa.array(keys, pa.int64())], names=names)
                if lists:
                    posted = np.concatenate(lists).view(np.int64)
                    none = pa.nulls(len(posted), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, pa.array(posted),
                                                      pa.array(np.concatenate(owners))], names=names)

    del types
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, r long, shingle long, key long")


def prefixes(postings: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """(shingle, key) of lists that candidates must share, from all postings."""
    # counts come from an aggregate with partials and go back by a join, which may split a shingle of many keys:
    # no list is gathered in one task.  Copies of a set in several tasks post it again; they count alike for all
    # keys of a shingle, so the order stays one for all, and they share a rank
    df = (postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("key").alias("a"), F.max("key").alias("z"))
          .where("a < z").select("shingle", "df"))
    p = postings.join(df, "shingle").join(info, "key")
    p = p.withColumn("tail", F.pmod("shingle", F.lit(1024)) >= _region(num / den))
    mine = Window.partitionBy("key")
    p = p.withColumn("rank", F.dense_rank().over(mine.orderBy("tail", "df", "shingle")))
    p = p.withColumn("shared", F.coalesce(F.max(F.when(~F.col("tail"), F.col("rank"))).over(mine), F.lit(0)))
    need = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")
    # shingles of no other key come first, then these by frequency; the tail is within reach as posted
    return p.where(F.col("tail") | (F.col("r") - F.col("shared") + F.col("rank") <= need)).select("shingle", "key")


def candidate_groups(lists: DataFrame) -> DataFrame:
    """(node, component) of the keys that share a list with another key."""
    stars = lists.groupBy("shingle").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return components(lists.join(stars, "shingle").where("a < key").select("a", F.col("key").alias("b")))


def bitmap(keys: DataFrame) -> bytes:
    """2^BITS bits with those of the keys' low bits set."""
    low = F.col("node").bitwiseAND((1 << BITS) - 1)
    rows = (keys.select(F.shiftright(low, 15).alias("page"), low.bitwiseAND(32767).alias("bit"))
            .groupBy("page").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits")).collect())
    out = bytearray(1 << (BITS - 3))
    for r in rows:
        out[r["page"] * 4096:(r["page"] + 1) * 4096] = r["bits"]
    return bytes(out)


def candidate_sets(docs: DataFrame, k: int, bits: bytes) -> DataFrame:
    """(key, members) of the texts whose key may be a candidate."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen, known = set(), shared.value
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                out = []
                found = shingles.sets(part.column("text"), k)
                for s, key in zip(found, _keys(found)):
                    if key is None or key in seen:
                        continue
                    low = key & ((1 << BITS) - 1)
                    if known[low >> 3] >> (low & 7) & 1:
                        seen.add(key)
                        out.append((key, s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                                      pa.array([x[1] for x in out], pa.binary())], names=["key", "members"])

    return docs.select("text").mapInArrow(run, "key long, members binary")


TILE_KEY = ["component", "one", "two", "i", "j"]


def tiles(members: DataFrame, t: float) -> DataFrame:
    """``members`` (key, component, n) -> (tile, key, side); side 0 is both."""
    band = F.floor(F.log("n") / (math.log(1 / t) * 1.001))
    members = materialize(members)
    total = members.count()
    small = members.groupBy(F.col("component").cast("string").alias("at")).agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("rows"))
    m = join_by_key(members.withColumn("at", F.col("component").cast("string")), small, "at", ["all"], "rows", total, ["key"])
    m = materialize(m.withColumn("band", F.when(F.col("all") > TILE, band).otherwise(F.lit(-1))).drop("at", "all"))
    sizes = m.groupBy("component", "band").agg(F.ceil(F.sum("n") / TILE).alias("chunks"), F.count(F.lit(1)).alias("rows"))
    near = sizes.where("band >= 0").select("component", F.explode(F.array(
        F.struct((F.col("band") - 1).alias("band"), F.col("chunks").alias("up"), F.lit(0).cast("long").alias("down")),
        F.struct((F.col("band") + 1).alias("band"), F.lit(0).cast("long").alias("up"), F.col("chunks").alias("down")))
    ).alias("x")).select("component", "x.*").groupBy("component", "band").agg(F.sum("up").alias("up"),
                                                                             F.sum("down").alias("down"))
    sizes = sizes.join(near, ["component", "band"], "left").na.fill(0, ["up", "down"])
    at = F.concat_ws(":", F.col("component").cast("string"), F.col("band").cast("string"))
    m = join_by_key(m.withColumn("at", at), sizes.withColumn("at", at), "at", ["chunks", "up", "down"], "rows", total, ["key"])
    m = m.withColumn("c", F.pmod(F.xxhash64("key"), F.col("chunks")))
    tile = lambda one, two, i, j, side: F.struct(one.alias("one"), two.alias("two"), i.alias("i"), j.alias("j"),
                                                 side.alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(
        F.expr("array()").cast("array<bigint>"))
    b, c = F.col("band"), F.col("c")
    own = F.transform(upto(F.col("chunks")), lambda j: tile(
        b, b, F.least(c, j), F.greatest(c, j), F.when(c == j, 0).when(c < j, 1).otherwise(2)))
    above = F.transform(upto(F.col("up")), lambda j: tile(b, b + 1, c, j, F.lit(1)))
    below = F.transform(upto(F.col("down")), lambda j: tile(b - 1, b, j, c, F.lit(2)))
    return m.select("component", "key", F.explode(F.concat(own, above, below)).alias("x")).select(
        "component", "x.one", "x.two", "x.i", "x.j", "x.side", "key")


class Index:
    """Inverted lists of some sets: shingle -> places of the sets."""

    def __init__(self, found: list[np.ndarray]):
        self.n = len(found)
        values = np.concatenate(found)
        place = np.repeat(np.arange(self.n), [len(s) for s in found])
        order = np.argsort(values, kind="stable")
        self.places = place[order]
        self.values, self.starts = np.unique(values[order], return_index=True)
        self.lengths = np.diff(np.append(self.starts, len(values)))
        self.entries = np.repeat(np.arange(len(self.values)), self.lengths) * self.n + self.places

    def search(self, s: np.ndarray, t: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, overlaps) of the ``wanted`` sets that share at least t
        shingles with s: DivideSkip."""
        at = np.searchsorted(self.values, s)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == s)]
        if len(at) < t:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = at[np.argsort(-self.lengths[at], kind="stable")]
        n_long = min(t - 1, int(t / (PROBE * math.log2(self.lengths[at[0]] + 1) + 1)))
        long, short = at[:n_long], at[n_long:]
        # merge the short lists: their sorted runs become one, and runs of a place are its count
        n = self.lengths[short]
        gather = np.arange(n.sum()) + np.repeat(self.starts[short] - np.cumsum(n) + n, n)
        merged = np.sort(self.places[gather], kind="stable")
        first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if len(merged) else np.zeros(0, np.int64)
        places, count = merged[first], np.diff(np.append(first, len(merged)))
        keep = (count >= t - n_long) & wanted[places]
        places, count = places[keep], count[keep]
        if n_long and len(places):
            # probe the long lists for the places that are left
            probe = (long[:, None] * self.n + places[None, :]).ravel()
            hit = np.searchsorted(self.entries, probe)
            hit = self.entries[np.minimum(hit, len(self.entries) - 1)] == probe
            count = count + hit.reshape(len(long), -1).sum(axis=0)
        keep = count >= t
        return places[keep], count[keep]


def link(keys: np.ndarray, side: np.ndarray, found: list[np.ndarray], num: int, den: int,
         copies: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links in a tile, between sides 1 and 2 or
    among all of side 0; with the ``copies`` of each set also its number of
    links to rows of others, for which all pairs are compared."""
    size = np.array([len(s) for s in found])
    order = np.argsort(size, kind="stable")
    right = order if (side == 0).all() else order[side[order] == 2]
    left = order if (side == 0).all() else order[side[order] == 1]
    count = np.zeros(len(found), np.int64)
    if not len(left) or not len(right):
        return [], count
    index, label, edges = Index([found[i] for i in right]), np.arange(len(found)), []
    for turn, i in enumerate(left):
        open_ = label[right] != label[i] if copies is None else np.ones(len(right), bool)
        if left is right:
            open_[turn:] = False  # smaller ones only: each pair once
        open_ &= (den * size[right] >= num * size[i]) & (num * size[right] <= den * size[i])
        if not open_.any():
            continue
        places, overlap = index.search(found[i], -(-num * int(size[i]) // den), open_)
        union = size[i] + size[right[places]] - overlap
        near = right[places[den * overlap >= num * union]]
        if copies is not None:
            count[i] += copies[near].sum()
            count[near] += copies[i]
        for j in near[label[near] != label[i]]:
            if label[j] != label[i]:
                edges.append((int(keys[i]), int(keys[j])))
                label[label == label[j]] = label[i]
    return edges, count


def links(tiled: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) keys: forests of the links, from all tiles; if ``tiled`` has
    copies, also rows (a, null, n) with a key's number of links in a tile."""
    counted = "copies" in tiled.columns
    own = ["key", "side", "members", *(["copies"] if counted else [])]

    def solve(rows):
        keys, side, raw, *copies = (list(x) for x in zip(*{r[0]: r for r in rows}.values()))
        edges, count = link(np.array(keys, np.int64), np.array(side), [np.frombuffer(x, np.uint64) for x in raw], num, den,
                            np.array(copies[0], np.int64) if counted else None)
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in edges] + [keys[i] for i in some], pa.int64()),
             pa.array([e[1] for e in edges] + [None] * len(some), pa.int64()),
             pa.array([None] * len(edges) + count[some].tolist(), pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (*TILE_KEY, *own)]
            for row in zip(*cols):
                if row[:5] != at and rows:
                    yield solve(rows)
                    rows = []
                at = row[:5]
                rows.append(row[5:])
        if rows:
            yield solve(rows)

    return (tiled.join(found, "key").select(*TILE_KEY, *own)
            .repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY).mapInArrow(run, "a long, b long, n long"))


def classes(docs: DataFrame, k: int, num: int, den: int, count_links: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_shingles, component_id: documents
    link when den * overlap >= num * union of their k-word shingle sets.
    With ``count_links`` also n_links, the number of rows that a row links with."""
    lean(docs.sparkSession)
    scanned = materialize(scan(docs, k, num, den))
    rows = scanned.where("n IS NOT NULL").select("doc_id", "n", "r", "key")
    per_key = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("r").alias("r"))
    per_key = materialize(per_key)
    postings = scanned.where("shingle IS NOT NULL").select("shingle", "key")
    lists = materialize(prefixes(postings, per_key.select("key", "n", "r"), num, den))
    groups = materialize(candidate_groups(lists))
    bits = bitmap(groups)
    members = groups.join(per_key.select(F.col("key").alias("node"), "n"), "node").select(
        F.col("node").alias("key"), "component", "n")
    tiled = tiles(members, num / den)
    if count_links:
        tiled = tiled.join(per_key.select("key", "copies"), "key")
    linked = materialize(links(tiled, candidate_sets(docs, k, bits), num, den))
    counts = linked.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    found = components(linked.where("b IS NOT NULL").select("a", "b"))
    # classes of keys that have a link, or that several documents share
    linked = per_key.join(found, F.col("key") == F.col("node"), "left").withColumn("class", F.coalesce("component", "key"))
    least = linked.where("component IS NOT NULL").groupBy("class").agg(F.min("rep").alias("least"))
    answer = linked.where("component IS NOT NULL OR copies > 1").join(least, "class", "left")
    values = ["component_id"]
    if count_links:
        answer = answer.join(counts, "key", "left")
        answer = answer.withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
        values.append("n_links")
    answer = (answer.withColumn("component_id", F.coalesce("least", "rep"))
              .select(F.col("key").cast("string").alias("key"), "copies", *values))
    total = rows.count()
    out = join_by_key(rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(
        F.col("key").cast("string"), F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")),
        materialize(answer), "key", values, "copies", total, ["doc_id"])
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []))


def first_of_class(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id;
    of rows that share this id one stays.  Rows without an id stay."""
    c = materialize(classes(docs, k, num, den)).where("doc_id IS NOT NULL")
    later = c.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(later, "doc_id", "left_anti")
    again = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept.select(docs.columns)
    again = materialize(again)
    once = kept.join(again, "doc_id", "left_anti")
    return once.unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def q_ngram_join(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100, count_links=True)


SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id,
  (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_links  -- ids are unique in the table
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""
