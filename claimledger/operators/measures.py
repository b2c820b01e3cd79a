"""Measure builders.

Each builder returns a :class:`Measure` whose parts are aggregate Columns
(algebraic: combine map-side in one pass), exact quantiles or rank
correlations.  Evaluation is in :mod:`claimledger.plans.evaluate`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimledger.registry import Agg, Measure, PyAgg, PyFold, Quantile, RankCorr, RowsPerUnit


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- D11 scalar ----------------------------------------------------------------

def mean(name: str, col) -> Measure:
    return Measure(name, "scalar", (("value", Agg(F.avg(_col(col)).cast("double"))),))


def median(name: str, col) -> Measure:
    return Measure(name, "scalar", (("value", Quantile(_col(col), 0.5)),))


def quantile(name: str, col, p: float) -> Measure:
    return Measure(name, "scalar", (("value", Quantile(_col(col), p)),))


def count_rows(name: str) -> Measure:
    return Measure(name, "scalar", (("value", Agg(F.count(F.lit(1)).cast("double"))),))


def total(name: str, col) -> Measure:
    """Sum of a column; 0 when there is nothing to add."""
    return Measure(name, "scalar", (("value", Agg(F.coalesce(F.sum(_col(col)).cast("double"), F.lit(0.0)))),))


def ratio(name: str, num, den) -> Measure:
    """sum(num) / sum(den); NULL instead of an error when the sum is 0."""
    return Measure(name, "scalar", (("value", Agg(
        F.try_divide(F.sum(_col(num)).cast("double"), F.sum(_col(den)).cast("double")))),))


# -- D12 -----------------------------------------------------------------------

def l2_norm(name: str, col) -> Measure:
    c = _col(col).cast("double")
    return Measure(name, "scalar", (("value", Agg(F.sqrt(F.sum(c * c)))),))


# -- D13 -----------------------------------------------------------------------

def proportion(name: str, pred: Column) -> Measure:
    """Share of rows meeting ``pred``; a missing input counts as "no"."""
    return Measure(name, "scalar", (("value", Agg(
        F.avg(F.coalesce(pred, F.lit(False)).cast("int")).cast("double"))),))


# -- D14 -----------------------------------------------------------------------

def rate(name: str, unit) -> Measure:
    """Rows per distinct unit (sessions per user), from rows counted per
    unit: no distinct count sits in the shared aggregate."""
    return Measure(name, "scalar", (("value", RowsPerUnit(_col(unit))),))


# -- D15 -----------------------------------------------------------------------

def any_row(name: str, pred: Column) -> Measure:
    """True when at least one row meets ``pred``; False on an empty frame."""
    return Measure(name, "boolean", (("value", Agg(
        F.coalesce(F.bool_or(F.coalesce(pred, F.lit(False))), F.lit(False)))),))


def no_row(name: str, pred: Column) -> Measure:
    return Measure(name, "boolean", (("value", Agg(
        ~F.coalesce(F.bool_or(F.coalesce(pred, F.lit(False))), F.lit(False)))),))


def has_missing(name: str, col) -> Measure:
    return any_row(name, _col(col).isNull())


# -- D16 -----------------------------------------------------------------------

DISTRIBUTION_KEYS = ["n", "mean", "std", "min", "q25", "median", "q75", "max"]


def distribution(name: str, col, keys: list[str] | None = None) -> Measure:
    """Summary of a column; missing values are skipped."""
    c = _col(col).cast("double")
    spec = {
        "n": Agg(F.count(c).cast("double")),
        "mean": Agg(F.avg(c)),
        "std": Agg(F.stddev_samp(c)),
        "min": Agg(F.min(c)),
        "q25": Quantile(c, 0.25),
        "median": Quantile(c, 0.5),
        "q75": Quantile(c, 0.75),
        "max": Agg(F.max(c)),
    }
    keys = keys or DISTRIBUTION_KEYS
    return Measure(name, "distribution", tuple((k, spec[k]) for k in keys))


# -- D17 -----------------------------------------------------------------------

def pearson(x: Column, y: Column) -> Column:
    """Pearson r over pairwise-complete rows; NULL (not an error) for a
    constant column."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(xx, yy), F.stddev_samp(xx) * F.stddev_samp(yy))


def corr_matrix(name: str, cols: list[str]) -> Measure:
    k = len(cols)
    # (j, i) reuses the expression of (i, j): the aggregate computes it once
    parts = tuple((f"{i},{j}", Agg(pearson(F.col(cols[min(i, j)]), F.col(cols[max(i, j)]))))
                  for i in range(k) for j in range(k))
    return Measure(name, "matrix", parts, shape=(k, k))


# -- D18 -----------------------------------------------------------------------

def spearman_matrix(name: str, cols: list[str]) -> Measure:
    k = len(cols)
    parts = tuple((f"{i},{j}", RankCorr(cols[i], cols[j])) for i in range(k) for j in range(k))
    return Measure(name, "matrix", parts, shape=(k, k))


def spearman(name: str, x: str, y: str) -> Measure:
    return Measure(name, "scalar", (("value", RankCorr(x, y)),))


# -- D19 -----------------------------------------------------------------------

def confusion_matrix(name: str, actual: str, predicted: str, domain: list) -> Measure:
    """Counts of (actual = domain[i], predicted = domain[j])."""
    k = len(domain)
    parts = tuple((f"{i},{j}", Agg(F.count_if(
        F.coalesce((F.col(actual) == F.lit(domain[i])) & (F.col(predicted) == F.lit(domain[j])),
                   F.lit(False))).cast("double")))
        for i in range(k) for j in range(k))
    return Measure(name, "matrix", parts, shape=(k, k))


# -- D20 -----------------------------------------------------------------------

def masked_vs_unmasked(name: str, col: str, sentinel) -> Measure:
    """Mean with and without masking a sentinel, in one pass."""
    c = F.col(col)
    return Measure(name, "distribution", (
        ("unmasked", Agg(F.avg(c).cast("double"))),
        ("masked", Agg(F.avg(F.when(~c.eqNullSafe(F.lit(sentinel)), c)).cast("double"))),
    ))


def python_measure(name: str, fn, columns: list[str], kind: str = "scalar") -> Measure:
    """``fn`` of the group's columns (pandas Series) -> number or bool;
    groups must fit in a task."""
    return Measure(name, kind, (("value", PyAgg(fn, tuple(columns))),))


def python_fold(name: str, partial, finish, columns: list[str], width: int, kind: str = "scalar") -> Measure:
    """``partial`` of a shard's columns -> ``width`` numbers, summed over
    the shards; ``finish`` of the sums -> number or bool; groups of any size."""
    return Measure(name, kind, (("value", PyFold(partial, finish, tuple(columns), width)),))
