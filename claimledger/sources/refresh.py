"""Incremental builds of derived tables (A10): only what changed is rebuilt.

A derived table that is an aggregate per key (per day) pins the content
fingerprint of every key's raw rows.  A refresh takes the fingerprints of
what exists now (one aggregate over the raw rows), compares them with the
pins, builds the changed and new keys from their rows alone and keeps the
rest of the previous table.  Equal to a full build whenever the build
depends on a key's rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.session import materialize
from claimledger.sources.fingerprint import content_fingerprint

KEPT, REBUILT, ADDED, REMOVED = "kept", "rebuilt", "added", "removed"


def pins(raw: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint, n_rows): what a build of ``raw`` has to remember."""
    return content_fingerprint(raw, keys=[key]).select(key, "fingerprint", "n_rows")


def refresh_plan(now: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """(key, action) of every key that exists now or did at the last build;
    rows without a key are one key of their own."""
    n = now.select(F.col(key).alias("_n"), F.col("fingerprint").alias("_now"), F.lit(True).alias("_here"))
    p = pinned.select(F.col(key).alias("_p"), F.col("fingerprint").alias("_pin"), F.lit(True).alias("_there"))
    action = (F.when(F.col("_there").isNull(), ADDED).when(F.col("_here").isNull(), REMOVED)
               .when(F.col("_now").eqNullSafe(F.col("_pin")), KEPT).otherwise(REBUILT))
    return n.join(p, F.col("_n").eqNullSafe(F.col("_p")), "full_outer").select(
        F.coalesce("_n", "_p").alias(key), action.alias("action"))


def refresh(previous: DataFrame, raw: DataFrame, pinned: DataFrame, key: str,
            build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, plan, new pins).  ``previous`` is the last result of ``build``
    (one row or more per key), ``pinned`` its pins.  The semi joins keep a
    hot key's rows where AQE can split them; nothing is collected."""
    now = materialize(pins(raw, key))
    plan = materialize(refresh_plan(now, pinned, key))

    def of(df: DataFrame, *actions: str) -> DataFrame:
        keys = plan.where(F.col("action").isin(*actions)).select(F.col(key).alias("_key"))
        return df.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")

    return of(previous, KEPT).unionByName(build(of(raw, REBUILT, ADDED))), plan, now
