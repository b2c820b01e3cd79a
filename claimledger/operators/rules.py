"""Cleanup rules (C1-C7): builders, ordered application and attrition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger.registry import Registry, Rule, chain_columns


def normalise_rule_id(rid: str) -> str:
    """``DR_001`` and ``DR-001`` name the same rule."""
    return rid.replace("_", "-")


# -- C1 / C2 / C3 / C4 builders ------------------------------------------------

def drop_equal(rid: str, col: str, value) -> Rule:
    """Drop rows equal to a sentinel; rows with a missing value stay."""
    return Rule(rid, keep=lambda c: ~c(col).eqNullSafe(F.lit(value)),
                description=f"drop {col} == {value!r}, keep missing")


def mask_equal(rid: str, col: str, value) -> Rule:
    """Replace a sentinel by NULL; the row count is unchanged."""
    return Rule(rid, masks=((col, lambda c: F.when(~c(col).eqNullSafe(F.lit(value)), c(col))),),
                description=f"mask {col} == {value!r}")


def row_all(cols: list[str], pred, c=F.col) -> Column:
    """Every listed column satisfies ``pred``; missing counts as false.
    Inside a rule pass the rule's accessor, so that the columns are read as
    the rules before it left them (``keep_all`` does)."""
    return reduce(lambda a, b: a & b, [F.coalesce(pred(c(col)), F.lit(False)) for col in cols])


def row_any(cols: list[str], pred, c=F.col) -> Column:
    """At least one listed column satisfies ``pred``; missing is false."""
    return reduce(lambda a, b: a | b, [F.coalesce(pred(c(col)), F.lit(False)) for col in cols])


def keep_all(rid: str, cols: list[str], pred) -> Rule:
    """C3 as a rule: keep rows whose listed columns all satisfy ``pred``."""
    return Rule(rid, keep=lambda c: row_all(cols, pred, c), description=f"all of {', '.join(cols)}")


def keep_any(rid: str, cols: list[str], pred) -> Rule:
    return Rule(rid, keep=lambda c: row_any(cols, pred, c), description=f"any of {', '.join(cols)}")


def keep_where(rid: str, pred, description: str = "") -> Rule:
    """Keep rows meeting ``pred`` (a function of a column accessor, e.g.
    ``lambda c: c("x") > 5``); missing inputs count as false."""
    return Rule(rid, keep=pred, description=description)


def range_rule(rid: str, col: str, lower=None, upper=None) -> Rule:
    """C4: time/range cutoff, inclusive lower bound, exclusive upper bound."""
    def keep(c):
        preds = []
        if lower is not None:
            preds.append(c(col) >= F.lit(lower))
        if upper is not None:
            preds.append(c(col) < F.lit(upper))
        return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)
    return Rule(rid, keep=keep, description=f"{col} in [{lower}, {upper})")


def recode_rule(rid: str, col: str, domain: list) -> Rule:
    """C4: closed domain; values outside it become NULL."""
    return Rule(rid, masks=((col, lambda c: F.when(c(col).isin(domain), c(col))),),
                description=f"{col} in {domain} else NULL")


# -- C5 ------------------------------------------------------------------------

def unknown_rules(ids: list[str], registry: Registry) -> list[str]:
    return [r for r in ids if normalise_rule_id(r) not in registry.rules]


def apply_rules(df: DataFrame, ids: list[str], registry: Registry) -> DataFrame:
    """Apply rules in order.  An unknown id is an error raised before any job."""
    missing = unknown_rules(ids, registry)
    if missing:
        raise KeyError(f"unknown rule(s): {missing}")
    return reduce(lambda acc, rid: registry.rules[normalise_rule_id(rid)].apply(acc), ids, df)


# -- C7 ------------------------------------------------------------------------

def attrition(df: DataFrame, ids: list[str], registry: Registry) -> DataFrame:
    """Rows remaining after each rule of the chain: (step, rule_id, rows).

    Row-local chains run in ONE pass: cumulative keep flags evaluated on the
    columns as each mask leaves them, summed in a single aggregate.  A chain
    holding a non-row-local rule falls back to one count per prefix.
    """
    missing = unknown_rules(ids, registry)
    if missing:
        raise KeyError(f"unknown rule(s): {missing}")
    rules = [registry.rules[normalise_rule_id(r)] for r in ids]
    spark = df.sparkSession
    if all(r.row_local for r in rules):
        flags = []
        for i in range(1, len(rules) + 1):
            _, flag = chain_columns(rules[:i], df.columns)
            flags.append(flag)
        sums = [F.count(F.lit(1)).alias("s0")] + [F.count_if(f).alias(f"s{i}") for i, f in enumerate(flags, 1)]
        row = df.agg(*sums)
        steps = F.array(*[F.struct(F.lit(i).alias("step"),
                                   F.lit(ids[i - 1] if i else None).cast("string").alias("rule_id"),
                                   F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("long").alias("rows"))
                          for i in range(len(rules) + 1)])
        return row.select(F.inline(steps))
    parts = []
    cur = df
    parts.append(cur.agg(F.count(F.lit(1)).alias("rows"))
                 .select(F.lit(0).alias("step"), F.lit(None).cast("string").alias("rule_id"), "rows"))
    for i, (rid, r) in enumerate(zip(ids, rules), start=1):
        cur = r.apply(cur)
        parts.append(cur.agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(i).alias("step"), F.lit(rid).alias("rule_id"), "rows"))
    return reduce(DataFrame.unionByName, parts)
