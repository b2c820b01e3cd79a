"""User-function surface: rules, measures, sources and extra checks.

Registries are code-sized (one entry per rule / measure / table the user
writes), so holding them on the driver is fine; the data never is.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Accessor = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """A named cleanup rule ``DR-NNN``.

    Row-local rules are a keep predicate and/or column masks, each written
    as a function of a column accessor (``lambda c: c("x") != 0``).  Written
    that way, a chain of rules can be evaluated on any version of the
    columns, so many chains over one source fuse into a single scan.  Any
    other rule is a ``DataFrame -> DataFrame`` function.
    """
    id: str
    keep: Callable[[Accessor], Column] | None = None
    masks: tuple[tuple[str, Callable[[Accessor], Column]], ...] = ()
    fn: Callable[[DataFrame], DataFrame] | None = None
    description: str = ""

    @property
    def row_local(self) -> bool:
        return self.fn is None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.fn is not None:
            return self.fn(df)
        if self.masks:
            df = df.withColumns({c: m(F.col) for c, m in self.masks})
        if self.keep is not None:
            # in a filter NULL drops the row like false; no coalesce, so the
            # predicate can reach the scan (PushedFilters)
            df = df.filter(self.keep(F.col))
        return df

    def definition(self) -> str:
        """Text that changes whenever the rule's logic changes."""
        if self.fn is not None:
            body = describe_function(self.fn)
        else:
            keep = str(self.keep(F.col)) if self.keep is not None else ""
            body = f"keep={keep};masks=" + ";".join(f"{k}={m(F.col)!s}" for k, m in self.masks)
        return f"{self.id}\n{body}"


def _describe_code(code) -> str:
    return "|".join([code.co_code.hex(), *code.co_names,
                     *[_describe_code(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts]])


def describe_function(value) -> str:
    """Text of a function: its code and what it closes over or defaults to,
    so that two functions from one factory differ where their values do."""
    code = getattr(value, "__code__", None)
    if code is None:
        text = repr(value)
        return type(value).__qualname__ if " at 0x" in text else text
    held = [describe_function(c.cell_contents) for c in (value.__closure__ or ())]
    defaults = [describe_function(d) for d in (*(value.__defaults__ or ()), *(value.__kwdefaults__ or {}).values())]
    return "|".join([_describe_code(code), *held, *defaults])


def chain_columns(rules: list[Rule], columns: list[str]) -> tuple[dict[str, Column], Column]:
    """Evaluate a row-local chain symbolically: (column -> expression after
    the chain's masks, keep flag).  Each rule sees the columns as the rules
    before it left them."""
    acc: dict[str, Column] = {c: F.col(c) for c in columns}
    flag = F.lit(True)
    for r in rules:
        if r.masks:
            snap = dict(acc)
            get = lambda n, snap=snap: snap.get(n, F.col(n))
            for c, m in r.masks:
                acc[c] = m(get)
        if r.keep is not None:
            cur = dict(acc)
            flag = flag & F.coalesce(r.keep(lambda n, cur=cur: cur.get(n, F.col(n))), F.lit(False))
    return acc, flag


@dataclass(frozen=True)
class Agg:
    """One algebraic aggregate part of a measure (combines map-side)."""
    expr: Column


@dataclass(frozen=True)
class Quantile:
    """Exact linear-interpolated quantile of a value expression."""
    expr: Column
    p: float


@dataclass(frozen=True)
class RowsPerUnit:
    """Rows per distinct non-NULL unit (sessions per user).  Evaluated in its
    own two-step aggregation instead of a ``count(distinct)`` inside the shared
    aggregate, which would make Spark expand every row for all aggregates."""
    unit: Column


@dataclass(frozen=True)
class RankCorr:
    """Spearman correlation of two columns (average ranks for ties)."""
    x: str
    y: str


@dataclass(frozen=True)
class PyAgg:
    """A Python function of the group's columns (pandas Series, in order) to
    one number or bool.  The whole group's columns are in one task's memory:
    for groups that fit there; ``PyFold`` is for groups of any size."""
    fn: Callable
    columns: tuple[str, ...]


@dataclass(frozen=True)
class PyFold:
    """A Python measure over groups of any size: ``partial`` maps a shard's
    columns (pandas Series, in order) to ``width`` numbers, these are summed
    over the shards, and ``finish`` maps the sums to the value (None: no
    value).  A shard is what one input partition holds of a group, so a hot
    group is as many shards as the table has partitions."""
    partial: Callable
    finish: Callable
    columns: tuple[str, ...]
    width: int


@dataclass(frozen=True)
class Measure:
    """A named measure.  ``kind`` is scalar, boolean, distribution or matrix.

    ``parts`` maps a part name to Agg / Quantile / RankCorr / PyAgg / PyFold.  Scalars and
    booleans have the single part ``value``; distributions use their keys;
    matrices use ``"i,j"`` and carry ``shape``.
    """
    name: str
    kind: str
    parts: tuple[tuple[str, object], ...]
    shape: tuple[int, int] | None = None


@dataclass
class Registry:
    rules: dict[str, Rule] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    sources: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    checks: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    # -- U1 ---------------------------------------------------------------
    def register_rule(self, rule: Rule) -> "Registry":
        self.rules[rule.id] = rule
        return self

    # -- U2 ---------------------------------------------------------------
    def register_measure(self, m: Measure) -> "Registry":
        self.measures[m.name] = m
        return self

    # -- sources ------------------------------------------------------------
    def register_source(self, name: str, loader: Callable[[SparkSession], DataFrame]) -> "Registry":
        self.sources[name] = loader
        return self

    # -- U3 ---------------------------------------------------------------
    def register_check(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> "Registry":
        self.checks[name] = fn
        return self

    def rules_fingerprint(self) -> str:
        """One hash over every rule definition; any change marks every
        dependant stale (deliberately coarse)."""
        h = hashlib.sha256()
        for rid in sorted(self.rules):
            h.update(self.rules[rid].definition().encode("utf-8"))
            h.update(b"\n\x00")
        return h.hexdigest()
