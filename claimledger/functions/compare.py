"""Typed comparisons of stored claims against recomputed values.

``is_close`` follows Python's ``math.isclose``: inclusive bound, NaN never
matches, an infinity only equals itself.  A naive ``abs(a - b) <= tol`` is
TRUE for NaN pairs and for inf against a finite number in Spark, hence the
explicit guards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimledger import model as M


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def is_close(expected, actual, rel=M.DEFAULT_REL_TOL, abs_=M.DEFAULT_ABS_TOL) -> Column:
    e, a, rel, abs_ = _c(expected).cast("double"), _c(actual).cast("double"), _c(rel), _c(abs_)
    both_finite = finite(e) & finite(a)
    bound = F.greatest(rel * F.greatest(F.abs(e), F.abs(a)), abs_)
    within = both_finite & (F.abs(e - a) <= bound)
    same_inf = e.isNotNull() & a.isNotNull() & ~F.isnan(e) & (e == a)
    return F.coalesce(within | same_inf, F.lit(False))


def resolve_tolerance(abs_tol: Column, rel_tol: Column) -> tuple[Column, Column]:
    """Stored tolerance if 0 <= t <= cap, else the default (NaN -> default)."""
    def pick(t: Column, cap: float, default: float) -> Column:
        ok = t.isNotNull() & ~F.isnan(t) & (t >= 0) & (t <= cap)
        return F.when(ok, t).otherwise(F.lit(default))
    return (pick(abs_tol.cast("double"), M.MAX_ABS_TOL, M.DEFAULT_ABS_TOL),
            pick(rel_tol.cast("double"), M.MAX_REL_TOL, M.DEFAULT_REL_TOL))


def compare_scalar(expected_num: Column, expected_other: Column, actual: Column,
                   rel: Column, abs_: Column) -> Column:
    """Missing expectation fails; numbers compare with ``is_close``; other
    values compare by equality."""
    return (F.when(expected_num.isNotNull(), is_close(expected_num, actual, rel, abs_))
             .when(expected_other.isNotNull(),
                   F.coalesce(expected_other == actual.cast("string"), F.lit(False)))
             .otherwise(F.lit(False)))


def compare_boolean(expected: Column, actual: Column) -> Column:
    """Both sides must be real booleans."""
    return F.coalesce(expected.isNotNull() & actual.isNotNull() & (expected == actual), F.lit(False))


def compare_distribution(expected: Column, actual: Column, rel: Column, abs_: Column) -> Column:
    """Non-empty, identical key sets, every value close.  Row-local:
    ``map_zip_with`` yields NULL on the side missing a key."""
    zipped = F.map_zip_with(expected, actual,
                            lambda k, e, a: is_close(e, a, rel, abs_) & e.isNotNull() & a.isNotNull())
    return F.coalesce(
        expected.isNotNull() & actual.isNotNull() & (F.size(expected) > 0)
        & (F.size(expected) == F.size(actual))
        & F.forall(F.map_values(zipped), lambda x: F.coalesce(x, F.lit(False))),
        F.lit(False))


def compare_matrix(expected: Column, actual: Column, rel: Column, abs_: Column) -> Column:
    """Same number of rows, same length per row, cell-wise close."""
    rows_ok = F.zip_with(
        expected, actual,
        lambda re, ra: F.coalesce(
            (F.size(re) == F.size(ra))
            & F.forall(F.zip_with(re, ra, lambda x, y: is_close(x, y, rel, abs_)),
                       lambda b: F.coalesce(b, F.lit(False))),
            F.lit(False)))
    return F.coalesce(
        expected.isNotNull() & actual.isNotNull() & (F.size(expected) > 0)
        & (F.size(expected) == F.size(actual))
        & F.forall(rows_ok, lambda b: b),
        F.lit(False))
