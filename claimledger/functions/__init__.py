"""Column-level building blocks (no jobs are started here)."""

from claimledger.functions.compare import (  # noqa: F401
    is_close, resolve_tolerance, compare_scalar, compare_boolean,
    compare_distribution, compare_matrix, finite,
)
from claimledger.functions.nulls import (  # noqa: F401
    nan_to_null, normalise_nans, ne_keep_missing, eq_false_if_missing,
)
