"""Missing-value semantics.

Source tables may carry NaN as well as NULL.  We normalise NaN to NULL at the
scan, after which NULL means "missing" and the helpers below reproduce the
usual data-frame idioms: a comparison with a missing value is false, a
"not equal" filter keeps missing rows, a mean skips missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def normalise_nans(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float/double column (one projection)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ne_keep_missing(c: Column, v) -> Column:
    """``c != v`` where a missing ``c`` counts as not equal (row kept)."""
    return ~c.eqNullSafe(F.lit(v))


def eq_false_if_missing(pred: Column) -> Column:
    """A predicate where missing inputs yield False instead of NULL."""
    return F.coalesce(pred, F.lit(False))
