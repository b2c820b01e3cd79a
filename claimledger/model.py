"""Ledger model: enums, fixed values, reason codes and the violations schema."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the ledger contract exactly.
# ---------------------------------------------------------------------------
CHECK_TYPES = ["scalar", "distribution", "matrix", "quote_provenance",
               "proportion", "rate", "boolean", "manual"]
REPLAYABLE_TYPES = ["scalar", "proportion", "rate", "boolean", "distribution", "matrix"]
SCALAR_TYPES = ["scalar", "proportion", "rate"]
TAGS = ["OBSERVED", "PLAUSIBLE", "WEAK"]
REQUIRED_FIELDS = ["id", "claim", "check_type", "code_path", "input", "reproducibility",
                   "caveats", "counterfactual_tag", "revision_history"]
ID_PATTERN = r"^F-\d{3,}[a-z]?$"
ID_IN_TEXT = r"F-\d{3,}[a-z]?"
RULE_ID_IN_TEXT = r"DR-\d+"
BACKLOG_ID_IN_TEXT = r"A-\d+"
STATUS_IN_TEXT = r"\*\*Status:\*\*\s*(\w+)"


def any_heading(level: str) -> str:
    return rf"^{level}\s"


def id_heading(level: str, id_regex: str) -> str:
    return rf"^{level}\s+({id_regex})\b[ \t]*[—:-]?[ \t]*(.*?)\s*$"


def field_line(name: str) -> str:
    return rf"(?m)\*\*{name}:\*\*\s*(.*?)\s*$"


LINE_REF_PATTERN = r"^L\d+(-L?\d+)?$"
IDENTIFIER_PATTERN = r"^[A-Za-z_][A-Za-z0-9_]*$"
DEFAULT_ABS_TOL = 1e-6
DEFAULT_REL_TOL = 1e-9
MAX_ABS_TOL = 1.0
MAX_REL_TOL = 0.1
OBSERVED_SHARE_LIMIT = 0.6
OBSERVED_MIN_FINDINGS = 5
ABANDONMENT_GAP = 10
LARGE_SOURCE_MB = 256
SAMPLE_ROWS = 200_000
RETIRED_RULE_STATUSES = ["dropped", "superseded"]
PLACEHOLDER_TOKEN = "{{MUST_CUSTOMIZE"
PENDING_PATTERN = r"[Pp]ending decision"

# Severities of a violation row.
FAIL, WARN, AUDIT = "FAIL", "WARN", "AUDIT"

# Replay reason codes, in priority order (the first failing test wins).
R_OK = "ok"
R_MANUAL = "manual"
R_NOT_CALLABLE = "measure_not_callable"
R_MEASURE_UNKNOWN = "measure_unknown"
R_SOURCE_COUNT = "source_count"
R_SOURCE_MISSING = "source_missing"
R_SOURCE_CHANGED = "source_changed"
R_RULE_UNKNOWN = "rule_unknown"
R_ROW_COUNT = "row_count"
R_NO_RESULT = "no_result"
R_TYPE = "type_mismatch"
R_VALUE = "value_mismatch"
R_QUOTE_MISSING = "quote_missing"
R_QUOTE_NOT_FOUND = "quote_not_found"
R_LOCATOR = "locator_outside_corpus"

# Health of a claim, derived from its reason code.
HEALTH_OF_REASON = {
    R_OK: "verified",
    R_MANUAL: "manual",
    R_SOURCE_MISSING: "cannot-verify",
    R_LOCATOR: "cannot-verify",
}

VIOLATIONS_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("check", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("finding_id", T.StringType()),
    T.StructField("detail", T.StringType()),
])

LEDGER_RAW_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("doc", T.StringType()),
])
