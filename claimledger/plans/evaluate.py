"""evaluate(): compute many measures over filtered frames.

All algebraic parts of all measures go into ONE aggregate together with the
row count (partial aggregation map-side).  Everything that needs values in
order or distinct (exact quantiles, rank correlations, rows per unit) reads
ONE pre-aggregated table: every row becomes one entry per such part, equal
entries are counted map-side, and the counts are written once.  Quantiles
and ranks then share one distributed cumulative pass over these counts,
however many measures and groups ask for them.  Python measures take one
scan more (two where both forms occur): built-in and Python aggregates
can't share one.

``evaluate_groups`` evaluates every (rule chain, key column) group over one
source in the same two jobs.  Each group reads the columns of its own
measures with its own filters (both reach the scan) and is aggregated for
these alone; a row is never copied per group, so what a row costs doesn't
grow with the measures that other groups ask for.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger.operators.ordered import cumulate, join_null_safe
from claimledger.registry import Agg, Measure, PyAgg, PyFold, Quantile, RankCorr, RowsPerUnit, Rule
from claimledger.session import materialize

VALUE_COLS = ["measure", "part", "num", "flag"]


def _part_exprs(m: Measure) -> list[Column]:
    out = []
    for _, spec in m.parts:
        if isinstance(spec, Agg):
            out.append(spec.expr)
        elif isinstance(spec, Quantile):
            out.append(F.max(spec.expr))
        elif isinstance(spec, RankCorr):
            out += [F.max(F.col(spec.x)), F.max(F.col(spec.y))]
        elif isinstance(spec, RowsPerUnit):
            out.append(F.max(spec.unit))
        elif isinstance(spec, (PyAgg, PyFold)):
            out += [F.max(F.col(f"`{c}`")) for c in spec.columns]
    return out


def analyse(df: DataFrame, measures: list[Measure]) -> tuple[list[Measure], dict[str, str]]:
    """Split measures into those that analyse on ``df`` and those that do not.

    Analysis only, no job: one broken measure fails its own claims, never
    the batch.
    """
    good, bad = [], {}
    empty = df.limit(0)
    for m in measures:
        try:
            empty.agg(*_part_exprs(m)).schema  # noqa: B018 - forces analysis
            good.append(m)
        except Exception as e:  # AnalysisException and friends
            bad[m.name] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
    return good, bad


Frame = tuple  # (DataFrame, names of the measures it is evaluated for)


def evaluate(df: DataFrame, measures: list[Measure], keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Return (rows, values).

    rows:   (keys..., rows)                       one row per key group
    values: (keys..., measure, part, num, flag)   one row per measure part
    """
    return _evaluate([(df, {m.name for m in measures})], measures, list(keys or []))


def _evaluate(frames: list[Frame], measures: list[Measure], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``evaluate`` over several frames of the same keys, each for its own
    measures: one job for what is algebraic, one for the counted values."""
    aggs: list[tuple[str, str, Column, bool]] = []
    quants: dict[str, tuple[Column, list[tuple[str, str, float]]]] = {}
    ranks: dict[tuple[str, str], list[tuple[str, str]]] = {}
    units: dict[str, tuple[Column, list[tuple[str, str]]]] = {}
    pys: list[tuple[str, str, object, bool]] = []
    for m in measures:
        for pname, spec in m.parts:
            if isinstance(spec, Agg):
                aggs.append((m.name, pname, spec.expr, m.kind == "boolean"))
            elif isinstance(spec, Quantile):
                quants.setdefault(str(spec.expr), (spec.expr, []))[1].append((m.name, pname, float(spec.p)))
            elif isinstance(spec, RankCorr):
                # symmetric: (y, x) is (x, y)
                ranks.setdefault(tuple(sorted((spec.x, spec.y))), []).append((m.name, pname))
            elif isinstance(spec, RowsPerUnit):
                units.setdefault(str(spec.unit), (spec.unit, []))[1].append((m.name, pname))
            elif isinstance(spec, (PyAgg, PyFold)):
                pys.append((m.name, pname, spec, m.kind == "boolean"))
            else:
                raise TypeError(f"unknown measure part {spec!r}")

    main = reduce(DataFrame.unionByName, [_algebraic(df, keys, [a for a in aggs if a[0] in names]) for df, names in frames])
    if keys and aggs:
        main = materialize(main)  # one row per group and part: row counts and values read it
    rows = main.where(F.col("measure").isNull()).select(*keys, "rows")

    found = []
    if aggs:
        found.append(main.where(F.col("measure").isNotNull()).select(*keys, *VALUE_COLS))
    if quants or ranks or units:
        counted = _counted(frames, keys, list(quants.values()), ranks, list(units.values()))
        if quants or ranks:
            cum = _cumulated(counted, keys)
            if quants:
                found.append(_quantiles(cum, keys, list(quants.values())))
            if ranks:
                found.append(_rank_corrs(counted, cum, keys, ranks))
        if units:
            found.append(_rows_per_unit(counted, keys, list(units.values())))

    for kind, run in ((PyAgg, _py_whole), (PyFold, _py_folded)):
        for df, names in frames:
            some = [p for p in pys if isinstance(p[2], kind) and p[0] in names]
            if some:
                found.append(run(df, keys, some))

    if not found:
        df = frames[0][0]
        schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
                           + ["measure string", "part string", "num double", "flag boolean"])
        values = df.sparkSession.createDataFrame([], schema)
    else:
        values = reduce(DataFrame.unionByName, found)
    return rows, values


def _algebraic(df: DataFrame, keys: list[str], aggs: list[tuple[str, str, Column, bool]]) -> DataFrame:
    """(keys..., measure, part, num, flag, rows): one row per part, and one
    with the row count and no measure."""
    text, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    entry = lambda mn, pn, num, flag, rows: F.struct(
        mn.alias("measure"), pn.alias("part"), num.alias("num"), flag.alias("flag"), rows.alias("rows"))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("_rows"),
                              *[expr.alias(f"_a{i}") for i, (_, _, expr, _) in enumerate(aggs)])
    structs = [entry(text, text, none, F.lit(None).cast("boolean"), F.col("_rows"))]
    structs += [entry(F.lit(mn), F.lit(pn), none if b else F.col(f"_a{i}").cast("double"),
                      F.col(f"_a{i}").cast("boolean") if b else F.lit(None).cast("boolean"), F.lit(None).cast("long"))
                for i, (mn, pn, _, b) in enumerate(aggs)]
    return g.select(*keys, F.inline(F.array(*structs)))


def _py_values(g: DataFrame, keys: list[str], pys) -> DataFrame:
    """Columns _p<i> of numbers -> one row per measure part."""
    structs = [F.struct(F.lit(mn).alias("measure"), F.lit(pn).alias("part"),
                        (F.lit(None).cast("double") if b else F.col(f"_p{i}")).alias("num"),
                        (F.col(f"_p{i}") != 0 if b else F.lit(None).cast("boolean")).alias("flag"))
               for i, (mn, pn, _, b) in enumerate(pys)]
    return g.select(*keys, F.inline(F.array(*structs)))


def _number(value) -> float | None:
    return None if value is None else float(value)


def _py_whole(df: DataFrame, keys: list[str], pys) -> DataFrame:
    """Python measures over whole groups, all in one aggregation of their
    own: Python and built-in aggregates can't share one.  A group goes to one
    task, as the function's contract says."""
    def udf(spec):
        def value(*columns: pd.Series) -> float:
            return _number(spec.fn(*columns))
        return F.pandas_udf(value, "double")

    g = df.groupBy(*keys).agg(*[
        udf(spec)(*[F.col(f"`{c}`") for c in spec.columns]).alias(f"_p{i}") for i, (_, _, spec, _) in enumerate(pys)])
    if not keys:  # a frame of no rows has no group: its measures have no value
        g = g.agg(*[F.first(f"_p{i}").alias(f"_p{i}") for i in range(len(pys))])
    return _py_values(g, keys, pys)


def _py_folded(df: DataFrame, keys: list[str], pys) -> DataFrame:
    """Python measures from sums over shards: shards are aggregated where
    they are dealt, their sums meet in an aggregate with partials, and the
    finishing function sees one row per group."""
    def shard(spec):
        def value(*columns: pd.Series) -> Any:
            return [float(x) for x in spec.partial(*columns)]
        return F.pandas_udf(value, "array<double>")

    def finished(spec):
        def value(sums: pd.Series) -> pd.Series:
            return pd.Series([None if s is None or s[0] is None else _number(spec.finish(*s)) for s in sums], dtype="float64")
        return F.pandas_udf(value, "double")

    g = df.withColumn("_shard", F.spark_partition_id()).groupBy(*keys, "_shard").agg(*[
        shard(spec)(*[F.col(f"`{c}`") for c in spec.columns]).alias(f"_v{i}") for i, (_, _, spec, _) in enumerate(pys)])
    g = g.groupBy(*keys).agg(*[F.array(*[F.sum(F.get(f"_v{i}", k)) for k in range(spec.width)]).alias(f"_s{i}")
                               for i, (_, _, spec, _) in enumerate(pys)])
    return _py_values(g.select(*keys, *[finished(spec)(f"_s{i}").alias(f"_p{i}") for i, (_, _, spec, _) in enumerate(pys)]),
                      keys, pys)


def _counted(frames: list[Frame], keys: list[str], quants, ranks, units) -> DataFrame:
    """(keys..., _s, _x, _y, _u, cnt): how often each value, pair of values
    or unit occurs.  ``_s`` names the part: q<i>, r<i>, u<i>.  Every frame is
    read once per part that its measures ask for, with that part's columns."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    entries = []
    for df, names in frames:
        def entry(name, x, y, u, good=None):
            own = df.where(good) if good is not None else df
            entries.append(own.select(*keys, F.lit(name).alias("_s"), x.alias("_x"), y.alias("_y"), u.alias("_u")))

        for i, (expr, uses) in enumerate(quants):
            if any(n in names for n, _, _ in uses):
                v = expr.cast("double")
                entry(f"q{i}", v, none, text, v.isNotNull())
        for i, ((x, y), uses) in enumerate(ranks.items()):
            if any(n in names for n, _ in uses):
                a, b = F.col(x).cast("double"), F.col(y).cast("double")
                entry(f"r{i}", a, b, text, a.isNotNull() & b.isNotNull())
        for i, (unit, uses) in enumerate(units):
            if any(n in names for n, _ in uses):
                entry(f"u{i}", none, none, unit.cast("string"))
    one = reduce(DataFrame.unionByName, entries)
    return materialize(one.groupBy(*keys, "_s", "_x", "_y", "_u").agg(F.count(F.lit(1)).alias("cnt")))


def _cumulated(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts of every quantile's values and of either side of
    every pair: one pass; ``_side`` is q<i>, r<i>x or r<i>y."""
    side = lambda s, v: F.struct(s.alias("_side"), v.alias("_v"))
    pair = F.col("_s").startswith("r")
    sides = F.when(pair, F.array(side(F.concat("_s", F.lit("x")), F.col("_x")), side(F.concat("_s", F.lit("y")), F.col("_y"))))
    sides = sides.otherwise(F.array(side(F.col("_s"), F.col("_x"))))
    each = counted.where(~F.col("_s").startswith("u")).select(*keys, "cnt", F.inline(sides))
    return cumulate(each.groupBy(*keys, "_side", "_v").agg(F.sum("cnt").alias("cnt")), [*keys, "_side"], "_v")


def _quantiles(cum: DataFrame, keys: list[str], specs: list[tuple[Column, list[tuple[str, str, float]]]]) -> DataFrame:
    """Every quantile of every expression from the cumulative counts."""
    probs = sorted({p for _, uses in specs for _, _, p in uses})
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.ceil(h)
        covers = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("cnt"))
        aggs += [F.max(F.when(covers(lo), F.col("_v"))).alias(f"lo{i}"),
                 F.max(F.when(covers(hi), F.col("_v"))).alias(f"hi{i}"),
                 F.first(h - lo).alias(f"fr{i}")]
    g = cum.where(F.col("_side").startswith("q")).groupBy(*keys, "_side").agg(*aggs)
    qs = F.array(*[F.struct(F.lit(p).alias("p"),
                            (F.col(f"lo{i}") + F.col(f"fr{i}") * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias("q"))
                   for i, p in enumerate(probs)])
    mapping = F.array(*[F.struct(F.lit(f"q{e}").alias("_me"), F.lit(p).alias("_mp"), F.lit(mn).alias("measure"),
                                 F.lit(pn).alias("part"))
                        for e, (_, uses) in enumerate(specs) for mn, pn, p in uses])
    return (g.select(*keys, "_side", F.inline(qs)).select(*keys, "_side", "p", "q", F.inline(mapping))
             .where((F.col("_side") == F.col("_me")) & (F.col("p") == F.col("_mp")))
             .select(*keys, "measure", "part", F.col("q").alias("num"), F.lit(None).cast("boolean").alias("flag")))


def _rows_per_unit(counted: DataFrame, keys: list[str], specs) -> DataFrame:
    """count(*) / count(distinct unit), exactly: the NULL unit is a group of
    its own and still counts rows."""
    g = counted.where(F.col("_s").startswith("u")).groupBy(*keys, "_s").agg(F.try_divide(
        F.sum("cnt").cast("double"), F.count_if(F.col("_u").isNotNull()).cast("double")).alias("num"))
    mapping = F.array(*[F.struct(F.lit(f"u{i}").alias("_ms"), F.lit(mn).alias("measure"), F.lit(pn).alias("part"))
                        for i, (_, uses) in enumerate(specs) for mn, pn in uses])
    return (g.select(*keys, "_s", "num", F.inline(mapping)).where(F.col("_s") == F.col("_ms"))
             .select(*keys, "measure", "part", "num", F.lit(None).cast("boolean").alias("flag")))


def _rank_corrs(counted: DataFrame, cum: DataFrame, keys: list[str],
                pairs: dict[tuple[str, str], list[tuple[str, str]]]) -> DataFrame:
    """Spearman r of every pair: weighted Pearson of average ranks over the
    distinct pairs of values (pairwise-complete rows).  Average ranks have
    the mean (n + 1) / 2, so centred ranks need no second pass."""
    centred = F.col("before") + (F.col("cnt") + 1) / 2.0 - (F.col("n") + 1) / 2.0
    rk = cum.where(F.col("_side").startswith("r")).select(*keys, "_side", "_v", centred.alias("_rank"))

    def side(name: str) -> DataFrame:
        return rk.where(F.col("_side").endswith(name)).select(
            *keys, F.expr("left(_side, length(_side) - 1)").alias("_s"), F.col("_v").alias(f"_{name}"),
            F.col("_rank").alias(f"_r{name}"))
    w = counted.where(F.col("_s").startswith("r")).select(*keys, "_s", "_x", "_y", "cnt")
    ranked = join_null_safe(join_null_safe(w, side("x"), [*keys, "_s", "_x"]), side("y"), [*keys, "_s", "_y"])
    a, b, c = F.col("_rx"), F.col("_ry"), F.col("cnt")
    corr = ranked.groupBy(*keys, "_s").agg(F.try_divide(
        F.sum(c * a * b), F.sqrt(F.sum(c * a * a)) * F.sqrt(F.sum(c * b * b))).alias("_rho"))
    mapping = F.array(*[F.struct(F.lit(f"r{i}").alias("_mr"), F.lit(mn).alias("measure"), F.lit(pn).alias("part"))
                        for i, pair in enumerate(pairs) for mn, pn in pairs[pair]])
    return (corr.select(*keys, "_s", "_rho", F.inline(mapping)).where(F.col("_s") == F.col("_mr"))
                .select(*keys, "measure", "part", F.col("_rho").alias("num"),
                        F.lit(None).cast("boolean").alias("flag")))


def evaluate_groups(df: DataFrame, groups: list[tuple[list[Rule], str | None]], measures: list[Measure],
                    usage: dict[str, list[int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """All groups over one source: (rows, values) keyed by (_g, _gk).

    ``usage`` maps a measure to the groups whose claims use it (None: every
    measure is evaluated for every group)."""
    frames = []
    for g, (chain, key) in enumerate(groups):
        own = reduce(lambda d, r: r.apply(d), chain, df)
        gk = F.col(key).cast("string") if key else F.lit(None).cast("string")
        frames.append((own.withColumns({"_g": F.lit(g), "_gk": gk}),
                       {m.name for m in measures if usage is None or g in usage.get(m.name, [])}))
    return _evaluate(frames, measures, ["_g", "_gk"])


def assemble(values: DataFrame, measures: list[Measure], keys: list[str] | None = None) -> DataFrame:
    """(keys..., measure, kind, num, flag, dist, matrix): one row per measure.

    Parts per measure are code-sized, so collecting them per group is bounded.
    """
    keys = list(keys or [])
    kinds = F.create_map(*[x for m in measures for x in (F.lit(m.name), F.lit(m.kind))]) \
        if measures else F.create_map().cast("map<string,string>")
    shapes = {m.name: m.shape for m in measures if m.kind == "matrix"}
    g = values.groupBy(*keys, "measure").agg(
        F.max(F.when(F.col("part") == "value", F.col("num"))).alias("num"),
        F.max(F.when(F.col("part") == "value", F.col("flag"))).alias("flag"),
        F.map_from_entries(F.collect_list(F.struct("part", "num"))).alias("_parts"))
    g = g.withColumn("kind", kinds[F.col("measure")])
    matrix = F.lit(None).cast("array<array<double>>")
    for name, (nr, nc) in shapes.items():
        built = F.transform(F.sequence(F.lit(0), F.lit(nr - 1)), lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(nc - 1)),
            lambda j: F.col("_parts")[F.concat(i.cast("string"), F.lit(","), j.cast("string"))]))
        matrix = F.when(F.col("measure") == name, built).otherwise(matrix)
    return g.select(*keys, "measure", "kind",
                    F.when(F.col("kind") != "boolean", F.col("num")).alias("num"), "flag",
                    F.when(F.col("kind") == "distribution", F.col("_parts")).alias("dist"),
                    F.when(F.col("kind") == "matrix", matrix).alias("matrix"))
