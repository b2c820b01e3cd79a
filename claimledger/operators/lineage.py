"""Lineage over several builds (G4, G5, C8): derived tables made from derived
tables.

Manifests are the edges of a graph from sources to outputs.  All closures go
by rounds: each round is one join of the last round's rows with the edges,
stored before the next, so a lost executor repeats one round and plans do not
grow.  The number of rounds is the length of the longest chain of builds.
A path visited once is not visited again: cycles end, and ``cycles`` reports
them.  The driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger import model as M
from claimledger.session import materialize

VCOLS = ["project", "check", "severity", "finding_id", "detail"]


def edges(manifests: DataFrame) -> DataFrame:
    """(output, source), each once; manifests without sources have none."""
    return (manifests.where("output IS NOT NULL").select("output", F.explode(F.map_keys("sources")).alias("source"))
            .distinct())


def ancestors(manifests: DataFrame) -> DataFrame:
    """(output, source, depth): everything an output was made from, directly
    or through other outputs, with the least number of builds between."""
    direct = materialize(edges(manifests))
    step = direct.select(F.col("output").alias("source"), F.col("source").alias("_next"))
    seen = frontier = direct.withColumn("depth", F.lit(1))
    depth = 1
    while True:
        depth += 1
        further = (frontier.join(step, "source").select("output", F.col("_next").alias("source")).distinct()
                   .join(seen.select("output", "source"), ["output", "source"], "left_anti"))
        frontier = materialize(further.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def claim_lineage(claims: DataFrame, manifests: DataFrame) -> DataFrame:
    """G4 over all builds: (project, id, source, raw_source, depth), where raw
    sources are those that no manifest has as its output.  Claims on a table
    that is no output keep one row without raw source."""
    c = claims.select("project", "id", F.explode_outer("sources").alias("s")).select(
        "project", "id", F.col("s.path").alias("source"))
    outputs = manifests.select(F.col("output").alias("raw_source")).distinct()
    raw = (ancestors(manifests).select(F.col("output").alias("source"), F.col("source").alias("raw_source"), "depth")
           .join(outputs, "raw_source", "left_anti"))
    return c.join(raw, "source", "left").select("project", "id", "source", "raw_source", "depth")


def stale_closure(manifests: DataFrame, stale: DataFrame) -> DataFrame:
    """(path, depth): the paths of ``stale`` (column path: changed sources,
    stale or missing outputs) at depth 0, and every output made from one of
    them at the least number of builds away."""
    step = materialize(edges(manifests)).select(F.col("source").alias("path"), "output")
    seen = frontier = materialize(stale.where("path IS NOT NULL").select("path").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        # the frontier holds a path once: a source with very many dependants is many rows on one side only
        further = frontier.join(step, "path").select(F.col("output").alias("path")).distinct().join(
            seen.select("path"), "path", "left_anti")
        frontier = materialize(further.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def changed_paths(manifests: DataFrame, current: DataFrame, rules_fingerprint: str | None) -> DataFrame:
    """(path): outputs and sources whose pinned fingerprint is not the current
    one, outputs that are gone, outputs built under other rules.  Absent
    sources can't be verified and count as unchanged, as in ``freshness``."""
    pinned = (manifests.select("output", F.col("output").alias("path"), F.col("output_sha256").alias("pin"),
                               F.lit(True).alias("own"))
              .unionByName(manifests.select("output", F.explode("sources").alias("path", "pin"), F.lit(False).alias("own"))))
    j = pinned.join(current.select("path", F.col("sha256").alias("now")), "path", "left")
    gone, other = F.col("now").isNull(), F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("pin"))
    # a source that differs makes its reader stale, not itself: other readers may have pinned the new one
    found = j.where((F.col("own") & gone) | other).select(F.col("output").alias("path"))
    if rules_fingerprint is not None:
        rules = manifests.where(F.col("rules_fingerprint") != F.lit(rules_fingerprint)).select(F.col("output").alias("path"))
        found = found.unionByName(rules)
    return found.distinct()


def transitive_freshness(manifests: DataFrame, current: DataFrame, rules_fingerprint: str | None,
                         fast: bool) -> DataFrame:
    """G5 / C8 over all builds: a violation for every output that is itself
    fresh but made, at whatever remove, from one that is not.  What is stale
    by its own pins is reported by ``freshness``."""
    marked = stale_closure(manifests, changed_paths(manifests, current, rules_fingerprint)).where("depth > 0")
    m = manifests.select("project", F.col("output").alias("path")).distinct().join(marked, "path")
    return m.select("project", F.lit("aggregate:freshness").alias("check"),
                    F.lit(M.WARN if fast else M.FAIL).alias("severity"), F.col("path").alias("finding_id"),
                    F.format_string("made from a stale table %d build(s) before", "depth").alias("detail")).select(*VCOLS)


def cycles(manifests: DataFrame) -> DataFrame:
    """A violation for every output that was made from itself, directly or
    through others.

    Edges whose source is no output, or whose output is nobody's source,
    cannot lie on a cycle and are peeled off round by round; what stays is
    cycles and the chains between them.  Only for that rest, empty in a sound
    ledger, the closure is built.
    """
    left = materialize(edges(manifests))
    n = left.count()
    while n:
        left = materialize(left.join(left.select(F.col("output").alias("source")).distinct(), "source", "left_semi")
                           .join(left.select(F.col("source").alias("output")).distinct(), "output", "left_semi")
                           .select("output", "source"))
        n, before = left.count(), n
        if n == before:
            break
    rest = left.groupBy("output").agg(F.map_from_entries(F.collect_set(F.struct("source", F.lit(""))))
                                      .alias("sources")) if n else None
    if rest is None:
        return manifests.select("project", F.lit("").alias("check"), F.lit("").alias("severity"),
                                F.lit("").alias("finding_id"), F.lit("").alias("detail")).where(F.lit(False))
    own = ancestors(rest).where("output = source").select("output", "depth")
    m = manifests.select("project", "output").distinct().join(own, "output")
    return m.select("project", F.lit("aggregate:lineage-cycle").alias("check"), F.lit(M.FAIL).alias("severity"),
                    F.col("output").alias("finding_id"),
                    F.format_string("made from itself over %d build(s)", "depth").alias("detail")).select(*VCOLS)
