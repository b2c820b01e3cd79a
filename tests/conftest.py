import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from claimledger.operators import measures as ms  # noqa: E402
from claimledger.operators import rules as rl  # noqa: E402
from claimledger.registry import Registry  # noqa: E402

# The 10-row sessions fixture (S006 is a zero sentinel).
SESSIONS = [
    ("S001", 4.0, "C1", 1), ("S002", 4.5, "C1", 2), ("S003", 5.0, "C1", 3),
    ("S004", 3.0, "C2", 1), ("S005", 4.0, "C2", 2), ("S006", 0.0, "C2", 3),
    ("S007", 4.5, "C3", 1), ("S008", 5.0, "C3", 2), ("S009", 3.5, "C3", 3), ("S010", 4.0, "C3", 4),
]
SESSIONS_SCHEMA = "session_id string, session_rating double, coach_id string, session_number int"


@pytest.fixture(scope="session")
def spark():
    ck = tempfile.mkdtemp(prefix="claimledger-test-ckpt-")
    s = (SparkSession.builder.master("local[2]").appName("claimledger-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
         .config("spark.checkpoint.dir", ck).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ck)
    yield s


@pytest.fixture()
def sessions(spark):
    return spark.createDataFrame(SESSIONS, SESSIONS_SCHEMA)


@pytest.fixture()
def registry(spark):
    reg = Registry()
    reg.register_source("sessions", lambda s: s.createDataFrame(SESSIONS, SESSIONS_SCHEMA))
    reg.register_rule(rl.drop_equal("DR-001", "session_rating", 0.0))
    reg.register_rule(rl.mask_equal("DR-002", "session_rating", 0.0))
    from pyspark.sql import functions as F
    for m in [ms.median("median_session_rating", "session_rating"),
              ms.mean("mean_session_rating", "session_rating"),
              ms.any_row("any_zero_rating", F.col("session_rating") == 0),
              ms.l2_norm("L2_norm", "session_rating"),
              ms.proportion("share_five", F.col("session_rating") == 5),
              ms.distribution("rating_summary", "session_rating", ["min", "median", "max"]),
              ms.corr_matrix("rating_matrix", ["session_rating", "session_number"])]:
        reg.register_measure(m)
    return reg


def finding(**over):
    d = {"id": "F-001", "claim": "test claim", "check_type": "scalar",
         "code_path": "analysis/02_profile.py:median_session_rating", "value": 4.0, "n": 10,
         "input": {"sources": [{"path": "sessions"}], "columns": ["session_rating"]},
         "reproducibility": {"filters": [], "row_count_after_filter": 10},
         "caveats": [], "counterfactual_tag": "PLAUSIBLE",
         "revision_history": [{"timestamp": "2026-01-01T00:00:00Z", "reason": "initial entry"}]}
    for k, v in over.items():
        if v is ...:
            d.pop(k, None)
        else:
            d[k] = v
    return d


def ledger_df(spark, *findings, project="p"):
    docs = [f if isinstance(f, str) else json.dumps(f) for f in findings]
    return spark.createDataFrame([(project, d) for d in docs], "project string, doc string")
