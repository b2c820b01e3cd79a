"""claimledger: keep published numbers true, on Spark.

A claim is one row in a ledger: it names a source table, the cleanup rules
applied to it, the row count expected after cleanup, the measure that
recomputes it and the tolerance allowed.  Everything here is an ordinary
DataFrame operator; nothing is collected to the driver except one-row
verdicts and registry-sized lists.
"""

from claimledger.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
