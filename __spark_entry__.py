"""

Every query reads the driver tables at ``sf_dir`` whole (no id subsets, no
row caps) and returns a DataFrame; every oracle is DuckDB SQL over the same
tables computing the same result independently.  Doubles are rounded to six
places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimledger.operators import profile as pf
from claimledger.operators.checks import extracted, group_checks, structural_checks, user_checks, verdict
from claimledger.sources.manifest import load_manifests
from claimledger.plans import oracle_ledger as OL
from claimledger.operators import rules as rl
from claimledger.operators.ordered import exact_quantiles
from claimledger.operators.registration import current_ledger, next_ids, register, register_computed, update
from claimledger.functions.compare import is_close, resolve_tolerance
from claimledger.operators.quotes import verify_quotes
from claimledger.plans import showcase as sc
from claimledger.operators import measures as ms
from claimledger.plans.evaluate import evaluate, evaluate_groups
from claimledger.plans.validate import validate
from claimledger.plans.replay import replay, replay_keyed, replay_summary
from claimledger.sources.ledger_io import to_document, typed
from claimledger.sources.scan import scan, scan_json_records
from claimledger.sources.fingerprint import (byte_fingerprint, content_fingerprint, large_source_warnings,
                                             source_sizes)
from claimledger.operators.status import freshness, lineage
from claimledger.operators.contract import duplicate_keys, quarantine, quarantine_duplicates, schema_drift
from claimledger.operators.quote_search import find_quotes
from claimledger.operators.textops import extract_ids, field, rule_statuses, sections, unfilled_placeholders
from claimledger.operators.status import (action_items, backlog_coverage, caveat_register, claim_detail,
                                          orphan_citations, publishable, rule_caveat_sync, rule_usage,
                                          status_banner, trust_buckets)
from claimledger.session import checkpoint_dir, materialize
from claimledger.operators.lineage import cycles, transitive_freshness
from claimledger.sources.records import flatten_records, sample_types
from claimledger.sources.refresh import REMOVED, pins, refresh
from claimledger.sources.raw_files import block_hashes, file_shapes, tree_roots
from claimledger.sources.scan import scan_tree
from claimledger.sources.ledger_io import read_ledger, split_json_arrays, write_ledger

NOW = "2026-01-01T00:00:00Z"


def _r(c, n: int = 6):
    """Round for comparison; the 1e-12 relative nudge makes exact halves
    round the same way in every engine (string- vs binary-based rounding)."""
    return F.round(c * F.lit(1.000000000001), n)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return sc.table(spark, sf, name)


# ---------------------------------------------------------------- A. scans

def q_scan_orders(spark, sf):
    o = scan(spark, f"{sf}/orders.parquet")
    return o.agg(F.count(F.lit(1)).alias("n_rows"),
                 _r(F.sum("o_totalprice"), 2).alias("total_price"),
                 F.count_if(F.col("o_totalprice").isNull()).alias("missing_prices"),
                 F.count_distinct("o_custkey").alias("n_customers"),
                 F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_date"),
                 F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_date"))


SQL_SCAN_ORDERS = """
SELECT count(*)::BIGINT AS n_rows, round(sum(o_totalprice), 2) AS total_price,
       count(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice))::BIGINT AS missing_prices,
       count(DISTINCT o_custkey)::BIGINT AS n_customers,
       strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_date
FROM orders"""


def q_events_props(spark, sf):
    e = scan_json_records(_t(spark, sf, "events"), "props", "k bigint")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"),
                                       F.count_if(F.col("k").isNull()).alias("missing_k"))


SQL_EVENTS_PROPS = """
SELECT event_type, count(*)::BIGINT AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k,
       count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL)::BIGINT AS missing_k
FROM events GROUP BY event_type"""


# ---------------------------------------------------------------- B. profile

def q_sample_and_count(spark, sf):
    return pf.sample_and_count(_t(spark, sf, "lineitem"), 1000)


SQL_SAMPLE_AND_COUNT = """
SELECT count(*)::BIGINT AS total_rows, least(count(*), 1000)::BIGINT AS sample_rows, count(*) > 1000 AS sampled
FROM lineitem"""


def q_describe_lineitem(spark, sf):
    return pf.describe(_t(spark, sf, "lineitem"), "lineitem").select("table", "column", "rows", "nulls")


def _sql_describe(table: str, cols: list[str], doubles: list[str]) -> str:
    parts = []
    for c in cols:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in doubles else "")
        parts.append(f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", count(*)::BIGINT AS rows, "
                     f"count(*) FILTER (WHERE {cond})::BIGINT AS nulls FROM {table}")
    return "\nUNION ALL ".join(parts)


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_first_orders(spark, sf):
    """B2: the first rows of a table (a top-k by key, no global sort)."""
    return pf.head(_t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), 5, ["o_orderkey"])


SQL_FIRST_ORDERS = "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5"


def q_column_profile_orders(spark, sf):
    p = pf.column_profile(_t(spark, sf, "orders"), "orders")
    return p.select("table", "column", _r(F.col("min")).alias("min"), _r(F.col("max")).alias("max"),
                    "count", "nulls", "distinct", "zeros", _r(F.col("share_at_max")).alias("share_at_max"))


def _sql_profile(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"{c}::DOUBLE"
        parts.append(
            f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", round(min({x}), 6) AS min, round(max({x}), 6) AS max, "
            f"count({x})::BIGINT AS count, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS nulls, "
            f"count(DISTINCT {x})::BIGINT AS distinct, count(*) FILTER (WHERE {x} = 0)::BIGINT AS zeros, "
            f"round(count(*) FILTER (WHERE {x} = (SELECT max({x}) FROM {table}))::DOUBLE / count(*), 6) AS share_at_max "
            f"FROM {table}")
    return "\nUNION ALL ".join(parts)


def q_domain_counts(spark, sf):
    return pf.domain_counts(_t(spark, sf, "orders"), "o_orderstatus")


SQL_DOMAIN_COUNTS = "SELECT o_orderstatus AS value, count(*)::BIGINT AS n FROM orders GROUP BY 1"


def q_top_priorities(spark, sf):
    return pf.domain_counts(_t(spark, sf, "orders"), "o_orderpriority", k=3)


SQL_TOP_PRIORITIES = """
SELECT o_orderpriority AS value, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, value ASC LIMIT 3"""


def q_all_zero_rows(spark, sf):
    return pf.all_zero_rows(_t(spark, sf, "lineitem"), ["l_discount", "l_tax"])


SQL_ALL_ZERO_ROWS = """
SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0)::BIGINT AS all_zero FROM lineitem"""


# ---------------------------------------------------------------- C. rules

def q_rule_drop_and_mask(spark, sf):
    """C1 + C2 + D20: dropping vs masking the zero discount sentinel."""
    reg = sc.registry(sf)
    li = _t(spark, sf, "lineitem")
    dropped = rl.apply_rules(li, ["DR-001"], reg)
    masked = rl.apply_rules(li, ["DR-002"], reg)
    a = dropped.agg(F.count(F.lit(1)).alias("rows_dropped"), _r(F.avg("l_discount")).alias("mean_discount_dropped"))
    b = masked.agg(F.count(F.lit(1)).alias("rows_masked"), F.count_if(F.col("l_tax").isNull()).alias("masked_tax"),
                   _r(F.avg("l_tax")).alias("mean_tax_masked"), _r(F.median("l_tax")).alias("median_tax_masked"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


SQL_RULE_DROP_AND_MASK = """
SELECT (SELECT count(*) FROM lineitem WHERE l_discount IS DISTINCT FROM 0)::BIGINT AS rows_dropped,
       (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_discount IS DISTINCT FROM 0) AS mean_discount_dropped,
       (SELECT count(*) FROM lineitem)::BIGINT AS rows_masked,
       (SELECT count(*) FILTER (WHERE l_tax = 0 OR l_tax IS NULL) FROM lineitem)::BIGINT AS masked_tax,
       (SELECT round(avg(CASE WHEN l_tax IS DISTINCT FROM 0 THEN l_tax END), 6) FROM lineitem) AS mean_tax_masked,
       (SELECT round(quantile_cont(CASE WHEN l_tax IS DISTINCT FROM 0 THEN l_tax END, 0.5), 6) FROM lineitem)
         AS median_tax_masked"""


def q_row_all_any(spark, sf):
    li = _t(spark, sf, "lineitem")
    pos = lambda c: c > 0
    return li.agg(F.count_if(rl.row_all(["l_discount", "l_tax"], pos)).alias("all_positive"),
                  F.count_if(rl.row_any(["l_discount", "l_tax"], pos)).alias("any_positive"))


SQL_ROW_ALL_ANY = """
SELECT count(*) FILTER (WHERE coalesce(l_discount > 0, false) AND coalesce(l_tax > 0, false))::BIGINT AS all_positive,
       count(*) FILTER (WHERE coalesce(l_discount > 0, false) OR coalesce(l_tax > 0, false))::BIGINT AS any_positive
FROM lineitem"""


def q_range_and_recode(spark, sf):
    reg = sc.registry(sf)
    o = rl.apply_rules(_t(spark, sf, "orders"), ["DR-201"], reg)
    li = rl.apply_rules(_t(spark, sf, "lineitem"), ["DR-005"], reg)
    a = o.agg(F.count(F.lit(1)).alias("orders_after_cutoff"))
    b = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")


SQL_RANGE_AND_RECODE = """
SELECT CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag END AS l_returnflag, count(*)::BIGINT AS n,
       (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1995-04-01')::BIGINT AS orders_after_cutoff
FROM lineitem GROUP BY 1"""


def q_attrition(spark, sf):
    reg = sc.registry(sf)
    return rl.attrition(_t(spark, sf, "lineitem"), ["DR-001", "DR-002", "DR-003", "DR-004"], reg)


SQL_ATTRITION = """
WITH f AS (
  SELECT l_discount IS DISTINCT FROM 0 AS k1, l_quantity > 5 AS k3, l_shipdate >= TIMESTAMP '1996-01-01' AS k4
  FROM lineitem)
SELECT 0 AS step, NULL::VARCHAR AS rule_id, count(*)::BIGINT AS rows FROM f
UNION ALL SELECT 1, 'DR-001', count(*) FILTER (WHERE k1)::BIGINT FROM f
UNION ALL SELECT 2, 'DR-002', count(*) FILTER (WHERE k1)::BIGINT FROM f
UNION ALL SELECT 3, 'DR-003', count(*) FILTER (WHERE k1 AND k3)::BIGINT FROM f
UNION ALL SELECT 4, 'DR-004', count(*) FILTER (WHERE k1 AND k3 AND k4)::BIGINT FROM f"""


# ---------------------------------------------------------------- D. measures

MEASURE_NAMES = ["mean_discount", "median_discount", "l2_quantity", "share_qty_over_25", "row_count",
                 "net_price_ratio", "any_zero_tax", "no_negative_quantity", "price_distribution",
                 "corr_qty_price_disc", "discount_masked_vs_unmasked", "lines_per_order"]


def q_measures_lineitem(spark, sf):
    """D11-D17, D20 evaluated together: one aggregate + quantile sub-plans."""
    reg = sc.registry(sf)
    ms = [reg.measures[n] for n in MEASURE_NAMES]
    rows, values = evaluate(_t(spark, sf, "lineitem"), ms)
    return values.select("measure", "part", _r(F.coalesce(F.col("num"), F.col("flag").cast("double"))).alias("value"))


SQL_MEASURES_LINEITEM = """
WITH s AS (SELECT
  avg(l_discount) AS mean_discount, quantile_cont(l_discount, 0.5) AS median_discount,
  sqrt(sum(l_quantity * l_quantity)) AS l2, avg(coalesce(l_quantity > 25, false)::INT) AS share25,
  count(*)::DOUBLE AS n, sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) AS ratio,
  coalesce(bool_or(coalesce(l_tax = 0, false)), false)::DOUBLE AS any_zero_tax,
  (NOT coalesce(bool_or(coalesce(l_quantity < 0, false)), false))::DOUBLE AS no_neg,
  count(l_extendedprice)::DOUBLE AS p_n, avg(l_extendedprice) AS p_mean, stddev_samp(l_extendedprice) AS p_std,
  min(l_extendedprice) AS p_min, quantile_cont(l_extendedprice, 0.25) AS p_q25,
  quantile_cont(l_extendedprice, 0.5) AS p_med, quantile_cont(l_extendedprice, 0.75) AS p_q75,
  max(l_extendedprice) AS p_max,
  corr(l_quantity, l_quantity) AS c00, corr(l_quantity, l_extendedprice) AS c01, corr(l_quantity, l_discount) AS c02,
  corr(l_extendedprice, l_extendedprice) AS c11, corr(l_extendedprice, l_discount) AS c12,
  corr(l_discount, l_discount) AS c22,
  avg(l_discount) AS unmasked, avg(CASE WHEN l_discount IS DISTINCT FROM 0 THEN l_discount END) AS masked,
  count(*)::DOUBLE / count(DISTINCT l_orderkey) AS lpo
  FROM lineitem)
SELECT measure, part, round(value, 6) AS value FROM s, (VALUES
  ('mean_discount', 'value'), ('median_discount', 'value'), ('l2_quantity', 'value'),
  ('share_qty_over_25', 'value'), ('row_count', 'value'), ('net_price_ratio', 'value'),
  ('any_zero_tax', 'value'), ('no_negative_quantity', 'value'),
  ('price_distribution', 'n'), ('price_distribution', 'mean'), ('price_distribution', 'std'),
  ('price_distribution', 'min'), ('price_distribution', 'q25'), ('price_distribution', 'median'),
  ('price_distribution', 'q75'), ('price_distribution', 'max'),
  ('corr_qty_price_disc', '0,0'), ('corr_qty_price_disc', '0,1'), ('corr_qty_price_disc', '0,2'),
  ('corr_qty_price_disc', '1,0'), ('corr_qty_price_disc', '1,1'), ('corr_qty_price_disc', '1,2'),
  ('corr_qty_price_disc', '2,0'), ('corr_qty_price_disc', '2,1'), ('corr_qty_price_disc', '2,2'),
  ('discount_masked_vs_unmasked', 'unmasked'), ('discount_masked_vs_unmasked', 'masked'),
  ('lines_per_order', 'value')) AS m(measure, part),
  LATERAL (SELECT CASE m.measure || '/' || m.part
    WHEN 'mean_discount/value' THEN mean_discount WHEN 'median_discount/value' THEN median_discount
    WHEN 'l2_quantity/value' THEN l2 WHEN 'share_qty_over_25/value' THEN share25
    WHEN 'row_count/value' THEN n WHEN 'net_price_ratio/value' THEN ratio
    WHEN 'any_zero_tax/value' THEN any_zero_tax WHEN 'no_negative_quantity/value' THEN no_neg
    WHEN 'price_distribution/n' THEN p_n WHEN 'price_distribution/mean' THEN p_mean
    WHEN 'price_distribution/std' THEN p_std WHEN 'price_distribution/min' THEN p_min
    WHEN 'price_distribution/q25' THEN p_q25 WHEN 'price_distribution/median' THEN p_med
    WHEN 'price_distribution/q75' THEN p_q75 WHEN 'price_distribution/max' THEN p_max
    WHEN 'corr_qty_price_disc/0,0' THEN c00 WHEN 'corr_qty_price_disc/0,1' THEN c01
    WHEN 'corr_qty_price_disc/0,2' THEN c02 WHEN 'corr_qty_price_disc/1,0' THEN c01
    WHEN 'corr_qty_price_disc/1,1' THEN c11 WHEN 'corr_qty_price_disc/1,2' THEN c12
    WHEN 'corr_qty_price_disc/2,0' THEN c02 WHEN 'corr_qty_price_disc/2,1' THEN c12
    WHEN 'corr_qty_price_disc/2,2' THEN c22
    WHEN 'discount_masked_vs_unmasked/unmasked' THEN unmasked
    WHEN 'discount_masked_vs_unmasked/masked' THEN masked
    WHEN 'lines_per_order/value' THEN lpo END AS value)"""


def q_quantiles_by_supplier(spark, sf):
    """Exact per-key quantiles with no key gathered into one task."""
    q = exact_quantiles(_t(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", [0.25, 0.5, 0.75])
    return q.select("l_suppkey", "p", _r(F.col("q")).alias("q"))


SQL_QUANTILES_BY_SUPPLIER = """
SELECT l_suppkey, p, round(CASE p WHEN 0.25 THEN q25 WHEN 0.5 THEN q50 ELSE q75 END, 6) AS q
FROM (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50,
             quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY l_suppkey),
     (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS v(p)"""


def q_spearman_lineitem(spark, sf):
    """Rank correlation by distributed average ranks."""
    reg = sc.registry(sf)
    rows, values = evaluate(_t(spark, sf, "lineitem"), [reg.measures["spearman_qty_price"]])
    return values.select("part", _r(F.col("num")).alias("rho"))


SQL_SPEARMAN_LINEITEM = """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rq,
                  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rp
           FROM lineitem),
c AS (SELECT corr(rq, rq) AS c00, corr(rq, rp) AS c01, corr(rp, rp) AS c11 FROM r)
SELECT part, round(CASE part WHEN '0,0' THEN c00 WHEN '1,1' THEN c11 ELSE c01 END, 6) AS rho
FROM c, (VALUES ('0,0'), ('0,1'), ('1,0'), ('1,1')) AS v(part)"""


def q_confusion_labels(spark, sf):
    """Quality x toxic counts as a 2x2 matrix, long form."""
    reg = sc.registry(sf)
    rows, values = evaluate(_t(spark, sf, "labels"), [reg.measures["quality_vs_toxic"]])
    return values.select("part", F.col("num").cast("long").alias("n"))


SQL_CONFUSION_LABELS = """
SELECT v.part, count(l.doc_id)::BIGINT AS n
FROM (VALUES ('0,0', 0, 0), ('0,1', 0, 1), ('1,0', 1, 0), ('1,1', 1, 1)) AS v(part, a, b)
LEFT JOIN labels l ON l.quality = v.a AND l.toxic = v.b GROUP BY v.part"""


def q_rate_by_event_type(spark, sf):
    """D14 per key: events per user, per event type (keyed evaluation)."""
    reg = sc.registry(sf)
    rows, values = evaluate(_t(spark, sf, "events"), [reg.measures["events_per_user"],
                                                     reg.measures["mean_event_value"]], ["event_type"])
    return (values.join(rows, "event_type")
                  .select("event_type", "measure", _r(F.col("num")).alias("value"), "rows"))


SQL_RATE_BY_EVENT_TYPE = """
SELECT event_type, measure, round(value, 6) AS value, rows FROM (
  SELECT event_type, count(*)::DOUBLE / count(DISTINCT user_id) AS epu, avg(value) AS mev, count(*)::BIGINT AS rows
  FROM events GROUP BY event_type) s,
  LATERAL (VALUES ('events_per_user', epu), ('mean_event_value', mev)) AS v(measure, value)"""


# ---------------------------------------------------------------- D8 replay

def lineitem_ledger(spark, sf, reg):
    """Register the lineitem claims computed, then seed drift into some."""
    empty = spark.createDataFrame([], "project string, doc string")
    acc, _ = register_computed(empty, sc.lineitem_specs(spark), reg, "initial entry", NOW)
    t = typed(acc)
    n = F.regexp_extract("id", r"F-(\d+)", 1).cast("int")
    t = (t.withColumn("value_v", F.lit(None).cast("variant"))
          .withColumn("value_num", F.when(n.isin(sc.DRIFT_VALUE), F.col("value_num") * 1.001)
                      .when(n.isin(sc.DRIFT_WITHIN_TOL), F.col("value_num") + 0.005)
                      .otherwise(F.col("value_num")))
          .withColumn("row_count", F.when(n.isin(sc.DRIFT_ROWS), F.col("row_count") + 1)
                      .otherwise(F.col("row_count")))
          .withColumn("distribution", F.when(n.isin(sc.DRIFT_DIST), F.transform_values(
              "distribution", lambda k, v: F.when(k == "mean", v * 1.01).otherwise(v))).otherwise(F.col("distribution")))
          .withColumn("matrix", F.when(n.isin(sc.DRIFT_MATRIX), F.transform("matrix", lambda row, i: F.transform(
              row, lambda x, j: F.when((i == 0) & (j == 1), x + 0.01).otherwise(x)))).otherwise(F.col("matrix"))))
    return materialize(to_document(t).select("project", "doc").unionByName(sc.extra_lineitem_claims(spark)))


def q_replay_lineitem(spark, sf):
    """D8 (+ E2, C6, D1-D6, D11-D20): register computed, drift, replay."""
    reg = sc.registry(sf)
    res = replay(typed(lineitem_ledger(spark, sf, reg)), reg)
    return res.select("id", "check_type", "status", "reason", "rows", _r(F.col("actual_num")).alias("actual"))


SQL_REPLAY_LINEITEM = r"""
WITH li AS (SELECT * FROM lineitem),
g1 AS (SELECT * FROM li WHERE l_discount IS DISTINCT FROM 0),
g2 AS (SELECT * REPLACE (CASE WHEN l_tax IS DISTINCT FROM 0 THEN l_tax END AS l_tax) FROM li),
g123 AS (SELECT * REPLACE (CASE WHEN l_tax IS DISTINCT FROM 0 THEN l_tax END AS l_tax) FROM g1 WHERE l_quantity > 5),
g3 AS (SELECT * FROM li WHERE l_quantity > 5),
g4 AS (SELECT * FROM li WHERE l_shipdate >= TIMESTAMP '1996-01-01'),
g14 AS (SELECT * FROM g1 WHERE l_shipdate >= TIMESTAMP '1996-01-01'),
r3 AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rq,
              rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rp
       FROM g3),
a AS (
  SELECT 'F-001' AS id, 'scalar' AS check_type, (SELECT count(*) FROM li) AS rows, (SELECT avg(l_discount) FROM li) AS actual, 0 AS kind
  UNION ALL SELECT 'F-002', 'scalar', (SELECT count(*) FROM g1), (SELECT avg(l_discount) FROM g1), 0
  UNION ALL SELECT 'F-003', 'scalar', (SELECT count(*) FROM g1), (SELECT quantile_cont(l_discount, 0.5) FROM g1), 0
  UNION ALL SELECT 'F-004', 'scalar', (SELECT count(*) FROM li), (SELECT quantile_cont(l_extendedprice, 0.5) FROM li), 1
  UNION ALL SELECT 'F-005', 'scalar', (SELECT count(*) FROM li), (SELECT sqrt(sum(l_quantity * l_quantity)) FROM li), 0
  UNION ALL SELECT 'F-006', 'proportion', (SELECT count(*) FROM g123), (SELECT avg(coalesce(l_quantity > 25, false)::INT) FROM g123), 0
  UNION ALL SELECT 'F-007', 'scalar', (SELECT count(*) FROM g123), (SELECT count(*)::DOUBLE FROM g123), 2
  UNION ALL SELECT 'F-008', 'scalar', (SELECT count(*) FROM g4), (SELECT sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) FROM g4), 1
  UNION ALL SELECT 'F-009', 'boolean', (SELECT count(*) FROM li), (SELECT coalesce(bool_or(coalesce(l_tax = 0, false)), false)::DOUBLE FROM li), 0
  UNION ALL SELECT 'F-010', 'boolean', (SELECT count(*) FROM g123), (SELECT coalesce(bool_or(l_tax IS NULL), false)::DOUBLE FROM g123), 0
  UNION ALL SELECT 'F-011', 'boolean', (SELECT count(*) FROM li), (SELECT (NOT coalesce(bool_or(coalesce(l_quantity < 0, false)), false))::DOUBLE FROM li), 0
  UNION ALL SELECT 'F-012', 'distribution', (SELECT count(*) FROM g1), NULL, 3
  UNION ALL SELECT 'F-013', 'matrix', (SELECT count(*) FROM li), NULL, 3
  UNION ALL SELECT 'F-014', 'matrix', (SELECT count(*) FROM g3), NULL, 0
  UNION ALL SELECT 'F-015', 'distribution', (SELECT count(*) FROM li), NULL, 0
  UNION ALL SELECT 'F-016', 'rate', (SELECT count(*) FROM li), (SELECT count(*)::DOUBLE / count(DISTINCT l_orderkey) FROM li), 0
  UNION ALL SELECT 'F-017', 'scalar', (SELECT count(*) FROM g2), (SELECT avg(l_tax) FROM g2), 4
  UNION ALL SELECT 'F-018', 'scalar', (SELECT count(*) FROM g2), (SELECT avg(l_tax) FROM g2), 1
  UNION ALL SELECT 'F-019', 'scalar', (SELECT count(*) FROM li), (SELECT quantile_cont(l_discount, 0.5) FROM li), 0
  UNION ALL SELECT 'F-020', 'scalar', (SELECT count(*) FROM g14), (SELECT avg(l_discount) FROM g14), 0),
c AS (
  SELECT *, CASE kind WHEN 1 THEN actual * 1.001 WHEN 4 THEN actual + 0.005 ELSE actual END AS stored,
         CASE kind WHEN 4 THEN 0.01 ELSE 1e-6 END AS abs_tol FROM a),
d AS (
  SELECT id, check_type, rows, actual,
         CASE WHEN kind = 2 THEN 'row_count'
              WHEN kind = 3 THEN 'value_mismatch'
              WHEN abs(stored - actual) <= greatest(1e-9 * greatest(abs(stored), abs(actual)), abs_tol) THEN 'ok'
              WHEN stored IS NULL AND actual IS NULL THEN 'ok'
              ELSE 'value_mismatch' END AS reason
  FROM c)
SELECT id, check_type, CASE reason WHEN 'ok' THEN 'PASS' ELSE 'FAIL' END AS status, reason, rows::BIGINT AS rows,
       round(actual, 6) AS actual FROM d
UNION ALL SELECT 'F-021', 'manual', 'AUDIT', 'manual', NULL, NULL
UNION ALL SELECT 'F-022', 'scalar', 'FAIL', 'measure_unknown', NULL, NULL
UNION ALL SELECT 'F-023', 'scalar', 'FAIL', 'rule_unknown', NULL, NULL
UNION ALL SELECT 'F-024', 'scalar', 'FAIL', 'measure_not_callable', NULL, NULL
UNION ALL SELECT 'F-025', 'scalar', 'FAIL', 'source_count', NULL, NULL"""


def q_replay_summary(spark, sf):
    """D10 over the lineitem replay."""
    reg = sc.registry(sf)
    res = replay(typed(lineitem_ledger(spark, sf, reg)), reg)
    return replay_summary(res)


SQL_REPLAY_SUMMARY = f"""
WITH r AS ({SQL_REPLAY_LINEITEM})
SELECT 'lineitem-project' AS project, count(*) FILTER (WHERE status = 'PASS')::BIGINT AS n_pass,
       count(*) FILTER (WHERE status = 'FAIL')::BIGINT AS n_fail,
       count(*) FILTER (WHERE status = 'AUDIT')::BIGINT AS n_audit, count(*)::BIGINT AS n_claims FROM r"""


# ---------------------------------------------------------------- F. checks

def _orders_checks(spark, sf):
    reg = sc.registry(sf)
    led = materialize(sc.orders_ledger(spark, sf))  # a ledger is a stored table
    columns = extracted(led)
    return led, structural_checks(columns, sorted(reg.measures)).unionByName(group_checks(columns))


def q_ledger_checks(spark, sf):
    """F1-F20 over one finding per order, defects seeded by key."""
    return _orders_checks(spark, sf)[1]


def q_verdict(spark, sf):
    """failures, warnings and exit code per project."""
    led, v = _orders_checks(spark, sf)
    return verdict(v, led).select("project", "failures", "warnings", F.col("exit_code").cast("int"))


# ---------------------------------------------------------------- A. identity

def q_content_fingerprint_orders(spark, sf):
    """Order-free, layout-free identity of a table in one aggregate; the
    second row is the table with prices moved by 1e-9."""
    o = _t(spark, sf, "orders")
    moved = o.withColumn("o_totalprice", F.col("o_totalprice") + 1e-9)
    return (content_fingerprint(o).withColumn("version", F.lit("as stored"))
            .unionByName(content_fingerprint(moved).withColumn("version", F.lit("moved"))))


SQL_CONTENT_FINGERPRINT_ORDERS = r"""
WITH o AS (SELECT 'as stored' AS version, * FROM orders
           UNION ALL SELECT 'moved', * REPLACE (o_totalprice + 1e-9 AS o_totalprice) FROM orders),
p AS (SELECT *, floor(log2(abs(o_totalprice))) AS e, abs(o_totalprice) / pow(2.0, floor(log2(abs(o_totalprice)))) AS m FROM o),
d AS (SELECT *, CASE WHEN m >= 2 THEN 1 WHEN m < 1 THEN -1 ELSE 0 END AS f FROM p),
t AS (SELECT *, CASE WHEN o_totalprice = 0 THEN '0' ELSE CASE WHEN o_totalprice < 0 THEN '-' ELSE '' END
        || (m * pow(2.0, 52 - f))::BIGINT::VARCHAR || 'p' || (e + f - 52)::BIGINT::VARCHAR END AS price FROM d),
r AS (SELECT version, sha256(concat_ws('|',
    coalesce(length(o_orderkey::VARCHAR) || ':' || o_orderkey::VARCHAR, '-'),
    coalesce(length(o_custkey::VARCHAR) || ':' || o_custkey::VARCHAR, '-'),
    coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-'),
    coalesce(length(price) || ':' || price, '-'),
    coalesce(length(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')) || ':' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), '-'),
    coalesce(length(o_orderpriority) || ':' || o_orderpriority, '-'))) AS h FROM t),
a AS (SELECT version, count(*) AS n, bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS x1,
             bit_xor(('0x' || substr(h, 16, 15))::BIGINT) AS x2,
             sum(('0x' || substr(h, 31, 15))::BIGINT)::DECIMAL(38,0) AS s3,
             sum(('0x' || substr(h, 46, 15))::BIGINT)::DECIMAL(38,0) AS s4 FROM r GROUP BY version)
SELECT n::BIGINT AS n_rows, sha256(concat_ws(':', n::VARCHAR, x1::VARCHAR, x2::VARCHAR, s3::VARCHAR, s4::VARCHAR))
       AS fingerprint, version FROM a"""


def q_byte_fingerprint_lineitem(spark, sf):
    """sha256 of the table's file bytes (equals sha256sum for one file):
    files read, and whether two reads of whole files agree."""
    one, two = (byte_fingerprint(spark, f"{sf}/{t}.parquet").select("source", "n_files", "bytes", "sha256")
                for t in ("lineitem", "lineitem"))
    return one.join(two.select("source", F.col("sha256").alias("again")), "source").select(
        "n_files", (F.col("bytes") > 0).alias("has_bytes"), ((F.col("sha256") == F.col("again"))
                                                             & F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("stable"))


SQL_BYTE_FINGERPRINT = "SELECT 1::BIGINT AS n_files, count(*) > 0 AS has_bytes, true AS stable FROM lineitem"


def q_file_trees(spark, sf):
    """A8 by ranges: every table's files cut into blocks of 1 MB that many
    tasks hash, and the root of each file's hash tree."""
    blocks = materialize(block_hashes(spark, sf, 1 << 20))
    return tree_roots(blocks).select(F.element_at(F.split("path", "/"), -1).alias("file"), "n_blocks", "bytes", "sha256")


def q_source_sizes(spark, sf):
    """Sizes from a file listing only, WARN at a threshold of 0 MB so
    every cited source is reported (as in the size check's own test)."""
    led = typed(sc.orders_ledger(spark, sf))
    sizes = source_sizes(spark, {t: f"{sf}/{t}.parquet" for t in ["lineitem", "orders"]})
    return large_source_warnings(led, sizes, 0).select(
        "project", "check", "severity", F.regexp_extract("detail", "^([a-z]+) is [0-9]+ MB", 1).alias("source"))


SQL_SOURCE_SIZES = """
SELECT DISTINCT 'proj-' || o_custkey % 10 AS project, 'source_size:large' AS "check", 'WARN' AS severity, unnest(
  CASE WHEN o_orderkey % 40 = 21 THEN ['orders', 'lineitem'] ELSE ['orders'] END) AS source
FROM orders WHERE o_orderkey % 40 <> 22"""


# ---------------------------------------------------------------- A10 / G4 / G5

def q_daily_events(spark, sf):
    """A10: rules applied once, small per-day aggregate."""
    return sc.daily_events(spark, sf, sc.registry(sf))


SQL_DAILY_EVENTS = """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n_events, round(sum(value), 2) AS total_value,
       count(DISTINCT user_id)::BIGINT AS n_users
FROM events WHERE event_type IS DISTINCT FROM 'error' AND event_type <> 'error' GROUP BY 1"""


def q_freshness_daily(spark, sf):
    """G5 (+ A6, A9 per key): every day's manifest against what exists now."""
    reg = sc.registry(sf)
    m = sc.daily_manifests(spark, sf, reg)
    cur = sc.day_fingerprints(spark, sf, reg)
    return freshness(m, cur, reg.rules_fingerprint(), fast=False)


SQL_FRESHNESS_DAILY = r"""
WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type <> 'error'),
r AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events),
m AS (SELECT day, day(day::DATE) AS dom,
             CASE WHEN day(day::DATE) = 30 THEN 'daily/day=missing' ELSE 'daily/day=' || day END AS output
      FROM d WHERE day IN (SELECT day FROM r))
SELECT 'events-project' AS project, 'aggregate:freshness' AS "check", 'FAIL' AS severity, output AS finding_id,
       'output is missing - rebuild' AS detail FROM m WHERE dom = 30
UNION ALL SELECT 'events-project', 'aggregate:freshness', 'FAIL', output, 'output changed since build'
  FROM m WHERE dom <> 30 AND (dom % 7 = 0 OR dom = 17)
UNION ALL SELECT 'events-project', 'aggregate:freshness', 'FAIL', output, 'source events/day=' || day || ' changed since build'
  FROM m WHERE dom <> 30 AND (dom % 5 = 0 OR dom = 19)
UNION ALL SELECT 'events-project', 'aggregate:unverifiable', 'WARN', output, 'source archive/day=' || day || ' not present'
  FROM m WHERE dom <> 30 AND dom % 11 = 0
UNION ALL SELECT 'events-project', 'aggregate:freshness', 'FAIL', output, 'a rule definition changed since build (rules DR-101)'
  FROM m WHERE dom = 13"""


def q_lineage_daily(spark, sf):
    """One claim per derived day -> raw sources, rules, build time."""
    reg = sc.registry(sf)
    m = sc.daily_manifests(spark, sf, reg)
    claims = m.select("project", F.concat(F.lit("F-"), F.regexp_replace(F.substring_index("output", "=", -1), "-", ""))
                      .alias("id"), F.array(F.struct(F.col("output").alias("path"),
                                                     F.lit(None).cast("string").alias("sha256"))).alias("sources"))
    return lineage(claims, m).select("project", "id", "source", "raw_source", "dr_set", "built_at")


SQL_LINEAGE_DAILY = r"""
WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type <> 'error'),
m AS (SELECT day, day(day::DATE) AS dom,
             CASE WHEN day(day::DATE) = 30 THEN 'daily/day=missing' ELSE 'daily/day=' || day END AS output FROM d)
SELECT 'events-project' AS project, 'F-' || replace(split_part(output, '=', 2), '-', '') AS id, output AS source,
       'events/day=' || day AS raw_source, 'DR-101' AS dr_set, '2026-01-01T00:00:00Z' AS built_at FROM m
UNION ALL
SELECT 'events-project', 'F-' || replace(split_part(output, '=', 2), '-', ''), output, 'archive/day=' || day,
       'DR-101', '2026-01-01T00:00:00Z' FROM m WHERE dom % 11 = 0"""


# ---------------------------------------------------------------- H. contracts

def q_schema_drift_orders(spark, sf):
    """A11 + H1-H6: lock a contract, then check the table against the lock."""
    from claimledger.operators.contract import contract_from_locks, lock_rows, lock_schema
    locks = lock_rows(spark, sc.contract(sc.LINEITEM_CONTRACT_COLUMNS), "lineitem")
    locks = lock_schema(locks, sc.contract(sc.ORDERS_CONTRACT_COLUMNS), "orders")
    rows = locks.where(F.col("source") == "orders").orderBy("column").collect()  # one contract: code-sized
    return schema_drift(_t(spark, sf, "orders"), contract_from_locks(rows), "orders")


SQL_SCHEMA_DRIFT_ORDERS = """
SELECT * FROM (
  SELECT 'orders' AS source, 'missing_column' AS "check", 'o_comment' AS "column", 1::BIGINT AS failures
  UNION ALL SELECT 'orders', 'coerce', 'o_orderstatus',
         (SELECT count(*) FROM orders WHERE o_orderstatus IS NOT NULL AND TRY_CAST(o_orderstatus AS INTEGER) IS NULL)
  UNION ALL SELECT 'orders', 'nullable', 'o_custkey', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
  UNION ALL SELECT 'orders', 'ge', 'o_custkey', (SELECT count(*) FROM orders WHERE o_custkey < 1)
  UNION ALL SELECT 'orders', 'nullable', 'o_orderkey', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL)
  UNION ALL SELECT 'orders', 'nullable', 'o_totalprice', (SELECT count(*) FROM orders WHERE o_totalprice IS NULL)
  UNION ALL SELECT 'orders', 'ge', 'o_totalprice', (SELECT count(*) FROM orders WHERE o_totalprice < 1000)
  UNION ALL SELECT 'orders', 'le', 'o_totalprice', (SELECT count(*) FROM orders WHERE o_totalprice > 400000)
  UNION ALL SELECT 'orders', 'unique', 'o_orderkey',
         (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
) WHERE failures > 0"""


def q_quarantine_lineitem(spark, sf):
    """H7: good rows vs rows carrying the reasons they fail."""
    good, bad = quarantine(_t(spark, sf, "lineitem"), sc.contract(sc.LINEITEM_CONTRACT_COLUMNS))
    reasons_ = bad.select(F.explode("reasons").alias("reason")).groupBy("reason").count()
    return (reasons_.select("reason", F.col("count").alias("n"))
            .unionByName(good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("reason"), "n"))
            .unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("quarantined").alias("reason"), "n")))


SQL_QUARANTINE_LINEITEM = """
WITH r AS (SELECT list_filter([
    CASE WHEN l_quantity < 1 THEN 'l_quantity:ge' END, CASE WHEN l_quantity > 45 THEN 'l_quantity:le' END,
    CASE WHEN l_discount < 0.01 THEN 'l_discount:ge' END, CASE WHEN l_discount > 0.1 THEN 'l_discount:le' END,
    CASE WHEN l_tax < 0 THEN 'l_tax:ge' END, CASE WHEN l_tax > 0.06 THEN 'l_tax:le' END,
    CASE WHEN l_orderkey IS NULL THEN 'l_orderkey:nullable' END], lambda x: x IS NOT NULL) AS reasons FROM lineitem)
SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason
UNION ALL SELECT 'good', count(*)::BIGINT FROM r WHERE len(reasons) = 0
UNION ALL SELECT 'quarantined', count(*)::BIGINT FROM r WHERE len(reasons) > 0"""


# ---------------------------------------------------------------- T. text

def q_rule_sections(spark, sf):
    """T1 + T2: sections of the decisions register and their fields."""
    s = sections(sc.decisions_docs(spark, sf), r"DR-\d+")
    return s.select("doc", "id", "title", field(F.col("body"), "Status").alias("status"),
                    field(F.col("body"), "Rule").alias("rule"))


SQL_RULE_SECTIONS = """
SELECT p_partkey AS doc, 'DR-' || (2 * p_partkey) AS id, trim(p_name) AS title,
       CASE p_size % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'Dropped' WHEN 2 THEN 'superseded' ELSE 'active' END AS status,
       trim(p_type) AS rule FROM part
UNION ALL
SELECT p_partkey, 'DR-' || (2 * p_partkey + 1), trim(p_brand), NULL, 'size ' || p_size FROM part"""


def q_rule_statuses(spark, sf):
    """Status per rule id, lower-cased, 'unknown' when none is stated."""
    return rule_statuses(sc.decisions_docs(spark, sf), carry=["project"])


SQL_RULE_STATUSES = """
SELECT 'p' || (p_partkey % 2) AS project, 'DR-' || (2 * p_partkey) AS id,
       CASE p_size % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'dropped' WHEN 2 THEN 'superseded' ELSE 'active' END AS status
FROM part
UNION ALL SELECT 'p' || (p_partkey % 2), 'DR-' || (2 * p_partkey + 1), 'unknown' FROM part"""


EMAIL = r"[A-Za-z0-9._]+@mail[0-9]+\.example\.com"


def q_extract_ids(spark, sf):
    """T4: every match of an id pattern over whole documents."""
    return extract_ids(_t(spark, sf, "documents"), EMAIL)


SQL_EXTRACT_IDS = f"""
SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(text, '{EMAIL}')) AS id FROM documents"""


def q_placeholders(spark, sf):
    """T5: documents still holding a literal token, with occurrences."""
    return unfilled_placeholders(_t(spark, sf, "documents"), "***")


SQL_PLACEHOLDERS = """
SELECT doc_id AS doc, ((length(text) - length(replace(text, '***', ''))) // 3)::BIGINT AS occurrences
FROM documents WHERE contains(text, '***')"""


# ---------------------------------------------------------------- G. cross-references

def q_orphan_citations(spark, sf):
    """G1 + G2: memo citations against the orders-derived ledger."""
    led = typed(sc.orders_ledger(spark, sf))
    return orphan_citations(led, sc.memo_docs(spark, sf))


_MEMO_SQL = r"""
memo AS (SELECT 'proj-' || (doc_id % 3) AS project, doc_id,
   '## Reliable' || chr(10) || 'See ' || printf('F-%06d', (doc_id * 37) % 30000) || ' and ' || printf('F-%06d', doc_id * 4)
   || '.' || chr(10) || text || chr(10) || '## Noisy' || chr(10) || 'Also ' || printf('F-%06d', doc_id * 4 + 1) || '.'
   || chr(10) AS text FROM documents)"""


def _sql_orphans() -> str:
    return rf"""WITH {OL.BASE}, {_MEMO_SQL},
cited AS (SELECT DISTINCT project, unnest(regexp_extract_all(text, 'F-\d{{3,}}[a-z]?')) AS id FROM memo),
known AS (SELECT DISTINCT project, id FROM t WHERE id IS NOT NULL),
orphans AS (SELECT * FROM cited EXCEPT SELECT * FROM known),
kmax AS (SELECT project, max(regexp_extract(id, '^F-(\d+)', 1)::BIGINT) AS kmax FROM known
         WHERE regexp_matches(id, '^F-\d') GROUP BY 1),
cmax AS (SELECT project, max(regexp_extract(id, '^F-(\d+)', 1)::BIGINT) AS cmax FROM cited GROUP BY 1)
SELECT project, 'trust_memo:orphans' AS "check", 'FAIL' AS severity, id AS finding_id,
       'memo cites unknown ' || id AS detail FROM orphans
UNION ALL
SELECT kmax.project, 'trust_memo:abandonment', 'WARN', NULL,
       printf('highest finding F-%03d but memo cites only up to F-%03d', kmax, cmax)
FROM kmax JOIN cmax USING (project) WHERE kmax - cmax > 10 AND project NOT IN (SELECT project FROM orphans)
UNION ALL
SELECT DISTINCT project, 'trust_memo:exists', 'WARN', NULL, 'no memo - orphan check skipped' FROM t
WHERE project NOT IN (SELECT project FROM memo)"""


def q_trust_buckets(spark, sf):
    """The bucket heading each claim is first cited under."""
    return trust_buckets(sc.memo_docs(spark, sf))


SQL_TRUST_BUCKETS = rf"""WITH {_MEMO_SQL},
l AS (SELECT project, doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM memo),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^##\s+') THEN trim(regexp_extract(line, '^##\s+(.*?)\s*$', 1)) END AS head
      FROM l),
b AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY project, doc_id ORDER BY pos
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bucket FROM h),
c AS (SELECT project, doc_id, pos, bucket, unnest(regexp_extract_all(line, 'F-\d{{3,}}[a-z]?')) AS id
      FROM b WHERE head IS NULL AND bucket IS NOT NULL)
SELECT project, id, arg_min(bucket, doc_id * 100000000 + pos) AS bucket FROM c GROUP BY project, id"""


def q_rule_caveat_sync(spark, sf):
    """Caveats register vs implemented rules vs rule statuses."""
    st = rule_statuses(sc.decisions_docs(spark, sf), carry=["project"])
    return rule_caveat_sync(sc.caveat_docs(spark, sf), sc.implemented_rules(spark, sf), st, fast=False)


SQL_RULE_CAVEAT_SYNC = r"""
WITH cav AS (SELECT 'p' || (s_suppkey % 2) AS project, s_suppkey,
   '### ' || s_name || chr(10) || '**Severity:** x' || chr(10) || 'Applies DR-' || (2 * s_suppkey) || ' and DR-'
   || (2 * s_suppkey + 1) || '.' || chr(10)
   || CASE WHEN s_suppkey % 4 = 0 THEN 'Pending decision on scope.' || chr(10) ELSE '' END
   || CASE WHEN s_suppkey % 50 = 1 THEN '{{MUST_CUSTOMIZE}}' || chr(10) ELSE '' END AS text FROM supplier),
filled AS (SELECT project FROM cav GROUP BY project HAVING max(contains(text, '{{MUST_CUSTOMIZE')::INT) = 0),
refs AS (SELECT DISTINCT project, unnest(regexp_extract_all(text, 'DR-\d+')) AS id FROM cav
         WHERE project IN (SELECT project FROM filled)),
impl AS (SELECT 'p' || (p_partkey % 2) AS project, 'DR-' || (2 * p_partkey) AS id FROM part
         WHERE p_size % 5 <> 0 AND 'p' || (p_partkey % 2) IN (SELECT project FROM filled)),
st AS (SELECT 'p' || (p_partkey % 2) AS project, 'DR-' || (2 * p_partkey) AS id,
              CASE p_size % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'dropped' WHEN 2 THEN 'superseded' ELSE 'active' END AS status
       FROM part
       UNION ALL SELECT 'p' || (p_partkey % 2), 'DR-' || (2 * p_partkey + 1), 'unknown' FROM part)
SELECT project, 'decisions_caveats:sync' AS "check", 'FAIL' AS severity, id AS finding_id,
       'caveats cite ' || id || ' but it has no implementation' AS detail
FROM (SELECT * FROM refs EXCEPT SELECT * FROM impl)
UNION ALL
SELECT r.project, 'decisions_caveats:sync', 'FAIL', r.id, 'caveats cite ' || r.id || ' but it is ' || st.status
FROM refs r JOIN impl i USING (project, id) JOIN st USING (project, id) WHERE st.status IN ('dropped', 'superseded')
UNION ALL
SELECT i.project, 'decisions_caveats:sync', 'FAIL', i.id, i.id || ' is active but not in the caveats register'
FROM impl i LEFT JOIN st USING (project, id)
WHERE coalesce(st.status, 'unknown') NOT IN ('dropped', 'superseded')
  AND (i.project, i.id) NOT IN (SELECT (project, id) FROM refs)
UNION ALL
SELECT project, 'decisions_caveats:pending', 'WARN', NULL,
       printf('%d caveat(s) still marked pending', sum(len(regexp_extract_all(text, '[Pp]ending decision'))))
FROM cav WHERE project IN (SELECT project FROM filled) GROUP BY project
HAVING sum(len(regexp_extract_all(text, '[Pp]ending decision'))) > 0"""


def q_caveat_register(spark, sf):
    """Heading and severity of every caveat section."""
    return caveat_register(sc.caveat_docs(spark, sf))


SQL_CAVEAT_REGISTER = """
SELECT 'p' || (s_suppkey % 2) AS project, s_suppkey AS doc, trim(s_name) AS heading,
       CASE s_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM supplier"""


def q_backlog_coverage(spark, sf):
    """Backlog question -> status -> the claims that address it
    (one claim per customer addresses its nation's question)."""
    bl = sections(sc.backlog_docs(spark, sf), r"A-\d+", carry=["project"]).select(
        "project", F.col("id").alias("aid"), field(F.col("body"), "Status").alias("status"),
        F.coalesce(field(F.col("body"), "Question"), F.col("title")).alias("question"))
    cust = _t(spark, sf, "customer").select(
        F.lit("customers-project").alias("project"), F.format_string("F-%06d", F.col("c_custkey")).alias("id"),
        F.array(F.concat(F.lit("A-"), F.col("c_nationkey").cast("string"))).alias("addresses"))
    return backlog_coverage(bl, cust)


SQL_BACKLOG_COVERAGE = """
SELECT 'customers-project' AS project, 'A-' || n_nationkey AS aid,
       CASE WHEN n_nationkey % 3 = 0 THEN 'answered' ELSE 'open' END AS status,
       'How much do customers in ' || n_name || ' spend?' AS question,
       count(c_custkey)::INT AS n_claims, min(printf('F-%06d', c_custkey)) AS first_claim
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"""


def q_rule_usage(spark, sf):
    """Rule -> status -> claims citing it (orders-derived ledger)."""
    reg = sc.registry(sf)
    rules = spark.createDataFrame([(p, rid, r.description) for rid, r in sorted(reg.rules.items())
                                   for p in [f"proj-{i}" for i in range(10)]], "project string, rid string, status string")
    use = rule_usage(rules, typed(sc.orders_ledger(spark, sf)).where(F.col("id").isNotNull()))
    return use.select("project", "rid", "n_claims")


def _sql_rule_usage(reg_ids: list[str]) -> str:
    vals = ", ".join(f"('{r}')" for r in reg_ids)
    return f"""WITH {OL.BASE},
f AS (SELECT project, id, CASE WHEN k % 5 = 0 THEN ['DR-201'] WHEN k % 5 = 1 THEN ['DR-201', 'DR-001'] ELSE [] END AS fl
      FROM t WHERE id IS NOT NULL),
u AS (SELECT project, unnest(fl) AS rid, id FROM f),
r AS (SELECT 'proj-' || i AS project, rid FROM range(10) AS x(i), (VALUES {vals}) AS v(rid))
SELECT r.project, r.rid, count(DISTINCT u.id)::INT AS n_claims FROM r LEFT JOIN u USING (project, rid)
GROUP BY r.project, r.rid"""


# ---------------------------------------------------------------- D9 + status

def customers_ledger(spark, sf, reg):
    """Register the per-customer claims computed, then drift every 7th."""
    empty = spark.createDataFrame([], "project string, doc string")
    acc, _ = register_computed(empty, sc.customer_specs(spark, sf), reg, "initial entry", NOW)
    t = typed(acc)
    key = F.col("group_key").cast("long")
    t = (t.withColumn("value_v", F.lit(None).cast("variant"))
          .withColumn("value_num", F.when((key % 7 == 0) & (F.col("measure") == "orders_count"), F.col("value_num") + 1)
                      .when(key % 7 == 0, F.col("value_num") * 1.01).otherwise(F.col("value_num"))))
    return materialize(to_document(t).select("project", "doc"))


def _customers_replay(spark, sf):
    reg = sc.registry(sf)
    docs = customers_ledger(spark, sf, reg)
    led = typed(docs)
    return docs, led, replay(led, reg)


def q_replay_keyed_customers(spark, sf):
    """One claim per (customer, measure), matched both ways: every 11th
    customer has no claims, every 13th one's claims name a key without data."""
    reg = sc.registry(sf)
    led, key = typed(customers_ledger(spark, sf, reg)), F.col("group_key").cast("long")
    led = led.where(key % 11 != 0).withColumn("group_key", F.when(key % 13 == 0, F.concat(F.lit("-"), "group_key"))
                                              .otherwise(F.col("group_key")))
    res = replay_keyed(led, reg)
    return res.select("id", "status", "reason", "rows", _r(F.col("actual_num")).alias("actual"))


_SQL_KEYED = r"""
c AS (SELECT c_custkey, c_nationkey FROM customer),
n_f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-04-01' GROUP BY 1),
n_a AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
k AS (
  SELECT printf('F-%06d', c_custkey) AS id, c_custkey, 'orders_count' AS measure,
         CASE WHEN c_custkey % 2 = 0 THEN f.n ELSE a.n END AS rows,
         (CASE WHEN c_custkey % 2 = 0 THEN f.n ELSE a.n END)::DOUBLE AS actual
  FROM c LEFT JOIN n_f f ON f.o_custkey = c_custkey LEFT JOIN n_a a ON a.o_custkey = c_custkey
  UNION ALL
  SELECT printf('F-%06d', c_custkey + 500000), c_custkey, 'mean_totalprice', a.n, a.mean
  FROM c LEFT JOIN n_a a ON a.o_custkey = c_custkey),
reg AS (SELECT *, CASE WHEN c_custkey % 7 = 0 AND measure = 'orders_count' THEN actual + 1
                       WHEN c_custkey % 7 = 0 THEN actual * 1.01 ELSE actual END AS stored
        FROM k WHERE rows IS NOT NULL),
res AS (SELECT 'customers-project' AS project, id, c_custkey, measure, rows, actual, stored,
          CASE WHEN abs(stored - actual) <= greatest(1e-9 * greatest(abs(stored), abs(actual)), 1e-6)
               THEN 'ok' ELSE 'value_mismatch' END AS reason FROM reg)"""


SQL_REPLAY_KEYED = f"""WITH {_SQL_KEYED},
lost AS (SELECT * FROM res WHERE c_custkey % 11 <> 0 AND c_custkey % 13 = 0),
kept AS (SELECT * FROM res WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0),
u AS (
  SELECT 'orders_count' AS m, o_custkey, n::DOUBLE AS actual FROM n_f
  WHERE o_custkey % 2 <> 0 OR o_custkey % 11 = 0 OR o_custkey % 13 = 0
  UNION ALL SELECT 'orders_count', o_custkey, n FROM n_a WHERE o_custkey % 2 = 0 OR o_custkey % 11 = 0 OR o_custkey % 13 = 0
  UNION ALL SELECT 'mean_totalprice', o_custkey, mean FROM n_a WHERE o_custkey % 11 = 0 OR o_custkey % 13 = 0)
SELECT id, CASE reason WHEN 'ok' THEN 'PASS' ELSE 'FAIL' END AS status, reason, rows::BIGINT AS rows,
       round(actual, 6) AS actual FROM kept
UNION ALL SELECT id, 'FAIL', 'no_result', NULL, NULL FROM lost
UNION ALL SELECT m || '[' || o_custkey || ']', 'FAIL', 'unclaimed_key', NULL, round(actual, 6) FROM u"""


def q_claim_status(spark, sf):
    """G6 + G12 + G13 + G15: health, shown value and publishability per claim."""
    _, led, res = _customers_replay(spark, sf)
    det = claim_detail(led, res)
    pub = publishable(led, res).select("project", "id", F.lit(True).alias("publishable"))
    return (det.join(pub, ["project", "id"], "left")
               .select("id", "health", "shown_value", F.coalesce("publishable", F.lit(False)).alias("publishable")))


SQL_CLAIM_STATUS = f"""WITH {_SQL_KEYED}
SELECT id, CASE reason WHEN 'ok' THEN 'verified' ELSE 'drifted' END AS health,
       CASE WHEN stored = floor(stored) THEN format('{{:,}}', stored::BIGINT)
            WHEN abs(stored) >= 999.5 AND abs(stored) < 9999.5 THEN format('{{:,}}', format('{{:.4g}}', stored)::DOUBLE::BIGINT)
            ELSE format('{{:.4g}}', stored) END AS shown_value,
       reason = 'ok' AND c_custkey % 5 <> 0 AS publishable FROM res"""


def q_status_banner(spark, sf):
    """Counts per health state, red and amber items, in sync or not."""
    docs, _, res = _customers_replay(spark, sf)
    return status_banner(res, group_checks(docs))


SQL_STATUS_BANNER = f"""WITH {_SQL_KEYED}
SELECT 'customers-project' AS project, count(*)::BIGINT AS n_claims,
       count(*) FILTER (WHERE reason = 'ok')::BIGINT AS verified,
       count(*) FILTER (WHERE reason <> 'ok')::BIGINT AS drifted, 0::BIGINT AS cannot_verify,
       0::BIGINT AS manual, 0::BIGINT AS red, 1::BIGINT AS amber, false AS in_sync FROM res"""


def q_action_items(spark, sf):
    """Every drifted claim and every failure or warning, with a fix."""
    docs, _, res = _customers_replay(spark, sf)
    return action_items(res, group_checks(docs))


SQL_ACTION_ITEMS = f"""WITH {_SQL_KEYED}
SELECT project, 'replay:' || id AS item, 'FAIL' AS severity,
       'Stored and computed value differ: register the claim again, or correct its measure.' AS fix
FROM res WHERE reason <> 'ok'
UNION ALL
SELECT 'customers-project', 'source_hash:unpinned:', 'WARN',
       'Pins of one source are absent or differ between claims: pin one version.'"""


# ---------------------------------------------------------------- D1 / D2 / D7

CLOSE_CASES = [
    # (kind, expected expression, actual expression) over lineitem
    ("same", "l_extendedprice", "l_extendedprice"),
    ("rel_1e-10", "l_extendedprice", "l_extendedprice * (1 + 1e-10)"),
    ("rel_1e-7", "l_extendedprice", "l_extendedprice * (1 + 1e-7)"),
    ("abs_5e-7", "l_quantity", "l_quantity + 5e-7"),
    ("abs_1e-3", "l_quantity", "l_quantity + 1e-3"),
    ("nan_vs_nan", "CAST('NaN' AS DOUBLE)", "CAST('NaN' AS DOUBLE)"),
    ("inf_vs_inf", "CAST('Infinity' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"),
    ("inf_vs_value", "CAST('Infinity' AS DOUBLE)", "l_extendedprice"),
    ("null_vs_value", "CAST(NULL AS DOUBLE)", "l_extendedprice"),
]


def q_is_close_grid(spark, sf):
    """Python isclose semantics on every lineitem row for each case."""
    li = _t(spark, sf, "lineitem")
    aggs = [F.count_if(is_close(F.expr(e), F.expr(a))).alias(k) for k, e, a in CLOSE_CASES]
    row = li.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_close"))
                                         for k, _, _ in CLOSE_CASES])))


def _sql_is_close_grid() -> str:
    def close(e, a):
        fin = lambda x: f"({x} IS NOT NULL AND isfinite({x}))"
        return (f"coalesce(({fin(e)} AND {fin(a)} AND abs(({e}) - ({a})) <= greatest(1e-9 * greatest(abs({e}), abs({a})), 1e-6))"
                f" OR (({e}) IS NOT NULL AND ({a}) IS NOT NULL AND NOT isnan({e}) AND ({e}) = ({a})), false)")
    parts = [f"SELECT '{k}' AS kind, count(*) FILTER (WHERE {close(e, a)})::BIGINT AS n_close FROM lineitem"
             for k, e, a in CLOSE_CASES]
    return "\nUNION ALL ".join(parts)


def q_tolerance_resolve(spark, sf):
    """Stored tolerances within [0, cap] are used, others fall back."""
    o = _t(spark, sf, "orders")
    ab = ((F.col("o_orderkey") % 7) - 1) / 2.0
    rel = (F.col("o_custkey") % 5) * 0.04 - 0.02
    a, r = resolve_tolerance(ab, rel)
    return o.select("o_orderkey", F.round(a, 12).alias("abs_tol"), F.round(r, 12).alias("rel_tol"))


SQL_TOLERANCE_RESOLVE = """
SELECT o_orderkey,
  round(CASE WHEN ((o_orderkey % 7) - 1) / 2.0 BETWEEN 0 AND 1.0 THEN ((o_orderkey % 7) - 1) / 2.0 ELSE 1e-6 END, 12) AS abs_tol,
  round(CASE WHEN (o_custkey % 5) * 0.04 - 0.02 BETWEEN 0 AND 0.1 THEN (o_custkey % 5) * 0.04 - 0.02 ELSE 1e-9 END, 12)
    AS rel_tol
FROM orders"""


def q_quote_checks(spark, sf):
    """Each quote claim must occur verbatim in the whole located text."""
    d = _t(spark, sf, "documents")
    k = F.col("doc_id")
    quote = (F.when(k % 4 == 2, F.reverse(F.substring("text", 11, 40)))
              .when(k % 4 == 3, F.lit("")).otherwise(F.substring("text", 11, 40)))
    loc = F.when(k % 4 == 1, F.concat(F.lit("doc-"), (k + 1000000).cast("string"))).otherwise(
        F.concat(F.lit("doc-"), k.cast("string"), F.lit(":L1-L3")))
    claims = d.select(F.format_string("F-%06d", k).alias("id"), quote.alias("quote"), loc.alias("source_locator"))
    corpus = d.select(F.concat(F.lit("doc-"), k.cast("string")).alias("locator"), "text")
    return verify_quotes(claims, corpus).select("id", "quote_reason")


SQL_QUOTE_CHECKS = """
WITH c AS (SELECT printf('F-%06d', doc_id) AS id,
                  CASE WHEN doc_id % 4 = 2 THEN reverse(substring(text, 11, 40)) WHEN doc_id % 4 = 3 THEN ''
                       ELSE substring(text, 11, 40) END AS quote,
                  CASE WHEN doc_id % 4 = 1 THEN 'doc-' || (doc_id + 1000000) ELSE 'doc-' || doc_id || ':L1-L3' END AS loc
           FROM documents),
d AS (SELECT 'doc-' || doc_id AS locator, text FROM documents)
SELECT id, CASE WHEN coalesce(quote, '') = '' THEN 'quote_missing'
                WHEN d.locator IS NULL THEN 'locator_outside_corpus'
                WHEN strpos(d.text, quote) > 0 THEN 'ok' ELSE 'quote_not_found' END AS quote_reason
FROM c LEFT JOIN d ON split_part(c.loc, ':', 1) = d.locator"""


# ---------------------------------------------------------------- E. registration

def q_register_batch(spark, sf):
    """E1 + E7: register the orders-derived findings into a ledger that
    already holds every tenth of them: (outcome, n)."""
    led = materialize(sc.orders_ledger(spark, sf))  # a ledger is a stored table
    existing = led.where(F.get_json_object("doc", "$.claim").rlike("0$"))
    acc, rej = register(existing, led, "batch", NOW)
    return (acc.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("outcome"), "n")
            .unionByName(rej.where(F.col("id").isNotNull()).select("project", "id").distinct()
                         .agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected_ids").alias("outcome"), "n")))


def _sql_register_batch(measure_names: list[str]) -> str:
    return f"""WITH {OL.BASE}, v AS ({OL.structural_sql(measure_names)}),
bad_check AS (SELECT DISTINCT project, finding_id AS id FROM v
              WHERE severity = 'FAIL' AND "check" NOT IN ('revision_history:nonempty', 'code_path:resolves',
                                                          'code_path:escapes') AND finding_id IS NOT NULL),
ids AS (SELECT project, id, k FROM t WHERE id IS NOT NULL),
dup AS (SELECT project, id FROM ids GROUP BY 1, 2 HAVING count(*) > 1),
ex AS (SELECT DISTINCT project, id FROM ids WHERE k % 10 = 0),
bad AS (SELECT * FROM bad_check UNION SELECT * FROM ex)
SELECT 'accepted' AS outcome, count(DISTINCT (project, id))::BIGINT AS n FROM ids
WHERE (project, id) NOT IN (SELECT (project, id) FROM bad)
UNION ALL SELECT 'rejected_ids', count(*)::BIGINT FROM (SELECT * FROM bad UNION SELECT * FROM dup)"""


def q_next_ids(spark, sf):
    """E5: ids for a batch of new claims (one per customer), per project
    continuing after the highest numeric id."""
    led = sc.orders_ledger(spark, sf)
    inc = _t(spark, sf, "customer").select(
        F.concat(F.lit("proj-"), (F.col("c_custkey") % 10).cast("string")).alias("project"), "c_custkey")
    return next_ids(led, inc, "c_custkey").select("project", "c_custkey", "new_id")


SQL_NEXT_IDS = f"""WITH {OL.BASE},
top AS (SELECT project, max(regexp_extract(id, '^F-(\\d+)', 1)::BIGINT) AS top FROM t
        WHERE regexp_matches(id, '^F-\\d') GROUP BY 1)
SELECT 'proj-' || (c_custkey % 10) AS project, c_custkey,
       printf('F-%03d', coalesce(top, 0) + row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey)) AS new_id
FROM customer LEFT JOIN top ON top.project = 'proj-' || (c_custkey % 10)"""


def q_update_revisions(spark, sf):
    """E3 + E4 + E6: update every third registered customer claim (new
    claim text; every ninth also a new input, whose stale fingerprint is
    dropped); an update stamps every missing fingerprint of a present
    source; then take the latest revision per id."""
    reg = sc.registry(sf)
    docs = customers_ledger(spark, sf, reg)
    revs = typed(docs).select("project", "id", F.lit(1).alias("rev")).join(
        docs.select("project", F.get_json_object("doc", "$.id").alias("id"), "doc"), ["project", "id"])
    key = F.get_json_object("doc", "$.group_key").cast("long")
    changes = revs.where(key % 3 == 0).select(
        "project", "id",
        F.when(key % 9 == 0, F.lit('{"claim": "revised", "input": {"sources": [{"path": "orders"}], "columns": []}}'))
         .when(key % 15 == 0, F.lit('{"claim": "revised", "check_type": "bogus"}'))
         .when(key % 21 == 0, F.lit('{"claim": "revised", "decisions": ["DR-009"], "addresses": ["A-1"], "n": 7, '
                                    '"owner": {"team": "data"}}'))
         .otherwise(F.lit('{"claim": "revised"}')).alias("doc"))
    fps = content_fingerprint(_t(spark, sf, "orders")).select(F.lit("orders").alias("source"),
                                                                 F.col("fingerprint").alias("sha256"))
    new, rejected = update(revs, changes, "revise", NOW, fps)
    cur = current_ledger(revs.unionByName(new))
    t = typed(cur.select("project", "doc")).join(cur.select("project", "id", "rev"), ["project", "id"])
    t = t.join(rejected.select("project", "id", F.lit(True).alias("rejected")), ["project", "id"], "left")
    return t.groupBy("rev", "claim").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source_sha256").isNotNull()).alias("n_pinned"),
        F.count_if(F.size("revision_history") == F.col("rev")).alias("n_history_ok"),
        F.count_if(F.col("rejected")).alias("n_rejected"),
        F.count_if((F.get_json_object("doc", "$.owner.team") == "data") & (F.col("n") == 7)
                   & (F.array_join("decisions", ",") == "DR-009") & (F.array_join("addresses", ",") == "A-1"))
        .alias("n_open_fields"))


SQL_UPDATE_REVISIONS = f"""WITH {_SQL_KEYED},
r AS (SELECT c_custkey, measure, c_custkey % 3 = 0 AND c_custkey % 9 <> 0 AND c_custkey % 15 = 0 AS rejected FROM res),
s AS (SELECT *, c_custkey % 3 = 0 AND NOT rejected AS done,
        c_custkey % 21 = 0 AND c_custkey % 9 <> 0 AND c_custkey % 15 <> 0 AS open FROM r)
SELECT CASE WHEN done THEN 2 ELSE 1 END AS rev,
       CASE WHEN done THEN 'revised' ELSE measure || ' of customer ' || c_custkey END AS claim,
       count(*)::BIGINT AS n, count(*) FILTER (WHERE done)::BIGINT AS n_pinned,
       count(*)::BIGINT AS n_history_ok, count(*) FILTER (WHERE rejected)::BIGINT AS n_rejected,
       count(*) FILTER (WHERE open)::BIGINT AS n_open_fields FROM s GROUP BY 1, 2"""


# ---------------------------------------------------------------- A2 / A4 / A5

def q_scan_tree(spark, sf):
    """A2: inventory of the raw-data tree: every data file, its format and
    true row count (listing and counts are distributed)."""
    inv = scan_tree(spark, sf)
    return inv.select(F.element_at(F.split("path", "/"), -1).alias("file"), "format", "rows")


def _sql_scan_tree() -> str:
    tables = ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split()
    return "\nUNION ALL ".join(f"SELECT '{t}.parquet' AS file, 'parquet' AS format, count(*)::BIGINT AS rows FROM {t}"
                               for t in tables)


def q_file_shapes(spark, sf):
    """A2: columns of every single file, read from the file itself."""
    names = F.array_join(F.transform("columns", lambda c: c["name"]), ",")
    return file_shapes(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("file"), "format",
                                         F.col("n_cols").cast("long").alias("n_cols"), names.alias("columns"), "error")


SQL_FILE_SHAPES = """
SELECT table_name || '.parquet' AS file, 'parquet' AS format, count(*)::BIGINT AS n_cols,
       string_agg(column_name, ',' ORDER BY ordinal_position) AS columns, NULL::VARCHAR AS error
FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents',
                     'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
GROUP BY table_name"""


def q_json_array_ingest(spark, sf):
    """A4: one JSON-array ledger text per order, defects seeded by key: a
    non-object element, broken JSON, an object instead of an array."""
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    f1 = F.format_string('{"id": "F-%06d", "claim": "x"}', k)
    f2 = F.format_string('{"id": "F-%06d", "claim": "y"}', k + 1000000)
    text = (F.when(k % 10 == 1, F.concat(F.lit("["), f1, F.lit(", 7]")))
             .when(k % 10 == 2, F.concat(F.lit("["), f1, F.lit(", {")))
             .when(k % 10 == 3, f1)
             .otherwise(F.concat(F.lit("["), f1, F.lit(", "), f2, F.lit("]"))))
    raw = o.select(F.concat(F.lit("proj-"), (F.col("o_custkey") % 10).cast("string")).alias("project"),
                   text.alias("text"))
    led, viol = split_json_arrays(raw)
    return (led.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit("finding").alias("kind"), "n")
            .unionByName(viol.groupBy("project", F.col("check").alias("kind")).agg(F.count(F.lit(1)).alias("n"))))


SQL_JSON_ARRAY_INGEST = """
WITH o AS (SELECT 'proj-' || (o_custkey % 10) AS project, o_orderkey % 10 AS m FROM orders)
SELECT project, 'finding' AS kind, sum(CASE WHEN m = 1 THEN 1 WHEN m IN (2, 3) THEN 0 ELSE 2 END)::BIGINT AS n
FROM o GROUP BY project HAVING n > 0
UNION ALL SELECT project, 'ledger:shape', count(*)::BIGINT FROM o WHERE m IN (1, 3) GROUP BY project
UNION ALL SELECT project, 'ledger:parses', count(*)::BIGINT FROM o WHERE m = 2 GROUP BY project"""


def q_ledger_round_trip(spark, sf):
    """A5: write the orders-derived ledger as a new immutable version in the
    shared checkpoint folder, publish it, read the published version back."""
    import uuid
    root = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    led = materialize(sc.orders_ledger(spark, sf))  # findings are built once, not again in the filter
    write_ledger(led.where(F.get_json_object("doc", "$.id").isNotNull()), root)
    back = read_ledger(spark, root)
    return back.groupBy("project").agg(F.count(F.lit(1)).alias("n"))


SQL_LEDGER_ROUND_TRIP = """
SELECT 'proj-' || (o_custkey % 10) AS project, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 20 <> 2 GROUP BY 1"""


# ---------------------------------------------------------------- A7 / F21

def q_load_manifests(spark, sf):
    """Manifests stored as JSON documents, one per derived day; every
    9th is truncated, every 10th has no output: (outcome, n)."""
    reg = sc.registry(sf)
    m = sc.daily_manifests(spark, sf, reg)
    dom = F.dayofmonth(F.try_to_date(F.substring_index("output", "=", -1)))  # NULL for the missing output
    doc = F.to_json(F.struct("output", "output_sha256", F.struct(
        "sources", "dr_set", F.col("rules_fingerprint").alias("decisions_fingerprint")).alias("inputs"), "built_at"))
    raw = m.select(F.col("output").alias("manifest_id"),
                   F.when(dom % 9 == 0, F.substring(doc, 1, 20))
                    .when(dom % 10 == 0, F.to_json(F.struct("output_sha256", "built_at")))
                    .otherwise(doc).alias("doc"))
    ok, bad = load_manifests(raw)
    return (ok.agg(F.count(F.lit(1)).alias("n")).select(F.lit("loaded").alias("outcome"), "n")
            .unionByName(bad.groupBy(F.col("detail").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))))


SQL_LOAD_MANIFESTS = """
WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type <> 'error'),
m AS (SELECT day(day::DATE) AS dom FROM d)
SELECT 'loaded' AS outcome, count(*) FILTER (WHERE dom % 9 <> 0 AND (dom % 10 <> 0 OR dom = 30))::BIGINT AS n FROM m
UNION ALL SELECT 'manifest does not parse', count(*)::BIGINT FROM m WHERE dom % 9 = 0 HAVING count(*) > 0
UNION ALL SELECT 'manifest has no output field', count(*)::BIGINT FROM m
  WHERE dom % 10 = 0 AND dom % 9 <> 0 AND dom <> 30 HAVING count(*) > 0"""


def q_user_checks(spark, sf):
    """a project-specific check registered by the user - claims about
    a priority order must apply the date rule DR-201."""
    reg = sc.registry(sf)

    def priority_needs_rule(ledger):
        t = typed(ledger)
        bad = t.where(F.col("claim").rlike("order [0-9]*5$") & ~F.array_contains("filters", "DR-201"))
        return bad.select("project", F.lit("project:priority_rule").alias("check"), F.lit("FAIL").alias("severity"),
                          F.col("id").alias("finding_id"), F.lit("claim must apply DR-201").alias("detail"))
    reg.register_check("priority_needs_rule", priority_needs_rule)
    return user_checks(sc.orders_ledger(spark, sf), reg.checks)


SQL_USER_CHECKS = f"""WITH {OL.BASE}
SELECT project, 'project:priority_rule' AS "check", 'FAIL' AS severity, id AS finding_id,
       'claim must apply DR-201' AS detail
FROM t WHERE k % 10 = 5 AND NOT (k % 3 = 0 OR k % 3 = 1) AND m40 NOT IN (24, 25, 26)
UNION ALL
SELECT project, 'project:priority_rule', 'FAIL', id, 'claim must apply DR-201'
FROM t WHERE k % 10 = 5 AND m40 IN (24, 25, 26)"""


# ---------------------------------------------------------------- whole runs

def q_validate_portfolio(spark, sf):
    """F1-F22 in one call over a portfolio with every defect of a document:
    violations by project, check and severity, and the verdict of each project."""
    reg = sc.registry(sf)
    found, verdicts = validate(sc.portfolio(spark, sf), reg, contracts={
        "customer": sc.contract([("c_custkey", "bigint", False, True, 0, None)]), "nowhere": sc.contract([]),
        "orders": ValueError("no JSON")})
    found = found.withColumn("check", F.regexp_replace("check", "^replay:F-.*", "replay"))  # one check per claim
    by = found.groupBy("project", "check", "severity").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(verdicts.select("project", F.lit("verdict").alias("check"),
                                          F.concat(F.lit("exit "), F.col("exit_code").cast("string")).alias("severity"),
                                          F.col("failures").alias("n")))


SQL_VALIDATE_PORTFOLIO = """
WITH c AS (SELECT 'team-' || c_custkey % 4 AS project, c_custkey % 18 AS kind FROM customer
           WHERE c_custkey % 4 <> 0 OR c_custkey % 18 >= 15),
d AS (SELECT * FROM (VALUES
  (0, 'ids:present'), (0, 'schema:required'), (1, 'schema:required'), (2, 'schema:required'), (2, 'check_type:valid'),
  (3, 'schema:required'), (3, 'code_path:form'), (4, 'schema:required'), (4, 'input:shape'), (5, 'schema:required'),
  (5, 'reproducibility:shape'), (6, 'schema:required'), (6, 'caveats:list'), (7, 'schema:required'),
  (7, 'counterfactual:valid'), (8, 'schema:required'), (8, 'revision_history:nonempty'), (9, 'input:shape'),
  (10, 'tolerance:value'), (11, 'tolerance:loose'), (12, 'ledger:parses'), (13, 'ledger:shape'),
  (14, 'ledger:parses')) AS t(kind, "check")),
p AS (SELECT DISTINCT project FROM c),
v AS (
  SELECT project, "check", 'FAIL' AS severity, count(*)::BIGINT AS n FROM c JOIN d USING (kind) GROUP BY 1, 2
  -- claims without a type or measure that replay can't run
  UNION ALL SELECT project, 'replay', 'FAIL', count(*) FROM c WHERE kind IN (2) GROUP BY 1
  UNION ALL SELECT project, 'replay:manual_findings', 'WARN', 1 FROM c WHERE kind NOT IN (2, 12, 13, 14) GROUP BY 1
  UNION ALL SELECT project, 'schema_drift', 'FAIL', 1 FROM p
  UNION ALL SELECT project, 'schema_drift', 'WARN', 1 FROM p)
SELECT * FROM v
UNION ALL SELECT project, 'verdict', 'exit 1', sum(n) FILTER (WHERE severity = 'FAIL')::BIGINT FROM v GROUP BY 1"""


def _bad_registry(sf):
    """The showcase with a rule, a measure and a source that do not fit."""
    reg = sc.registry(sf)
    reg.register_source("gone", lambda s: s.read.parquet(f"{sf}/no_such_table.parquet"))
    reg.register_rule(rl.drop_equal("DR-901", "no_such_column", 1))
    reg.register_rule(rl.keep_where("DR-902", lambda c: c("o_totalprice") < 0))
    reg.register_measure(ms.mean("price_as_date", F.col("o_orderpriority").cast("date").cast("string").cast("double")))
    reg.register_measure(ms.any_row("any_urgent", F.col("o_orderpriority") == "1-URGENT"))
    reg.register_measure(ms.total("sum_totalprice", "o_totalprice"))
    return reg


def _order_claims(spark, sf, claims):
    """Typed claims on orders: (id, type, measure, filters, further fields);
    values and row counts come from the table itself."""
    row = _t(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")).first()
    docs = []
    for i, kind, measure, filters, more in claims:
        rows = 0 if "DR-902" in filters else row["n"]
        more = {k: (row[v[1:]] if isinstance(v, str) and v.startswith("$") else v) for k, v in more.items()}
        docs.append(("orders-project", sc._claim(i, kind, measure, more.pop("on", "orders"), filters, **{
            "reproducibility": {"filters": filters, "row_count_after_filter": more.pop("rows", rows)}, **more})))
    return typed(spark.createDataFrame(docs, "project string, doc string"))


def q_replay_isolated(spark, sf):
    """Groups that can't be evaluated, each beside good claims."""
    led = _order_claims(spark, sf, [
        (1, "scalar", "mean_totalprice", [], {"value": "$mean"}), (2, "scalar", "orders_count", [], {"value": "$n"}),
        (3, "scalar", "orders_count", ["DR-901"], {"value": 1}), (4, "scalar", "orders_count", [], {"value": 1, "on": "gone"}),
        (5, "scalar", "orders_count", [], {"value": 1, "group_by": "nope", "group_key": "1"}),
        (6, "scalar", "price_as_date", [], {"value": 1}), (7, "scalar", "mean_discount", [], {"value": 1})])
    return replay(led, _bad_registry(sf)).select("id", "status", "reason", "rows", _r(F.col("actual_num")).alias("actual"))


SQL_REPLAY_ISOLATED = """
SELECT 'F-001' AS id, 'PASS' AS status, 'ok' AS reason, count(*)::BIGINT AS rows, round(avg(o_totalprice), 6) AS actual FROM orders
UNION ALL SELECT 'F-002', 'PASS', 'ok', count(*), count(*) FROM orders
UNION ALL SELECT 'F-003', 'FAIL', 'rule_error', NULL, NULL UNION ALL SELECT 'F-004', 'FAIL', 'source_missing', NULL, NULL
UNION ALL SELECT 'F-005', 'FAIL', 'group_key_unknown', NULL, NULL
UNION ALL SELECT 'F-006', 'FAIL', 'measure_error', count(*), NULL FROM orders
UNION ALL SELECT 'F-007', 'FAIL', 'measure_error', count(*), NULL FROM orders"""


def q_replay_empty(spark, sf):
    """D8 + C6: rules that leave no row; claims on nothing hold or drift."""
    none = ["DR-902"]
    led = _order_claims(spark, sf, [
        (1, "scalar", "orders_count", none, {"value": 0}), (2, "boolean", "any_urgent", none, {"value": False}),
        (3, "scalar", "sum_totalprice", none, {"value": 0}), (4, "scalar", "mean_totalprice", none, {"value": 1}),
        (5, "scalar", "orders_count", none, {"value": 1}), (6, "boolean", "any_urgent", none, {"value": True}),
        (7, "scalar", "orders_count", none, {"value": 0, "rows": 3}), (8, "scalar", "orders_count", [], {"value": "$n"})])
    return replay(led, _bad_registry(sf)).select("id", "status", "reason", "rows", _r(F.col("actual_num")).alias("actual"))


SQL_REPLAY_EMPTY = """
WITH e AS (SELECT * FROM orders WHERE o_totalprice < 0)
SELECT 'F-001' AS id, 'PASS' AS status, 'ok' AS reason, count(*)::BIGINT AS rows, count(*)::DOUBLE AS actual FROM e
UNION ALL SELECT 'F-002', 'PASS', 'ok', count(*), coalesce(bool_or(o_orderpriority = '1-URGENT'), false)::DOUBLE FROM e
UNION ALL SELECT 'F-003', 'PASS', 'ok', count(*), coalesce(sum(o_totalprice), 0) FROM e
UNION ALL SELECT 'F-004', 'FAIL', 'value_mismatch', count(*), avg(o_totalprice) FROM e
UNION ALL SELECT 'F-005', 'FAIL', 'value_mismatch', count(*), count(*) FROM e
UNION ALL SELECT 'F-006', 'FAIL', 'value_mismatch', count(*), coalesce(bool_or(o_orderpriority = '1-URGENT'), false)::DOUBLE FROM e
UNION ALL SELECT 'F-007', 'FAIL', 'row_count', count(*), count(*) FROM e
UNION ALL SELECT 'F-008', 'PASS', 'ok', count(*), count(*) FROM orders"""


def q_replay_python(spark, sf):
    """Python measures beside built-in ones in one ledger: whole groups,
    shards of any size, a bool, one that raises, and one on no rows."""
    reg = _bad_registry(sf)

    def fails(c):
        raise ValueError("no value")
    reg.register_measure(ms.python_measure("midrange", lambda c: None if c.empty else (c.min() + c.max()) / 2, ["o_totalprice"]))
    reg.register_measure(ms.python_measure("two_columns", lambda p, c: bool((p > c).all()), ["o_totalprice", "o_custkey"], "boolean"))
    reg.register_measure(ms.python_measure("fails", fails, ["o_totalprice"]))
    reg.register_measure(ms.python_fold(
        "price_variance", lambda c: (len(c), (c - 150000).sum(), ((c - 150000) ** 2).sum()),
        lambda n, s, q: None if n < 2 else (q - s * s / n) / (n - 1), ["o_totalprice"], 3))
    led = _order_claims(spark, sf, [
        (1, "scalar", "mean_totalprice", [], {"value": "$mean"}), (2, "scalar", "midrange", [], {"value": 1}),
        (3, "scalar", "price_variance", [], {"value": 1}), (4, "boolean", "two_columns", [], {"value": True}),
        (5, "scalar", "fails", [], {"value": 1}), (6, "scalar", "midrange", ["DR-902"], {"value": 1}),
        (7, "scalar", "price_variance", ["DR-902"], {"value": 1}),
        (8, "scalar", "midrange", [], {"value": 1, "group_by": "o_orderstatus", "group_key": "F", "rows": -1})])
    out = replay(led, reg)
    return out.select("id", "status", "reason", "rows", F.round(F.col("actual_num") / 1000, 3).alias("actual"))


SQL_REPLAY_PYTHON = """
WITH o AS (SELECT count(*)::BIGINT AS n, round(avg(o_totalprice) / 1000, 3) AS mean, round((min(o_totalprice) + max(o_totalprice)) / 2000, 3) AS mid,
             round(var_samp(o_totalprice) / 1000, 3) AS v, bool_and(o_totalprice > o_custkey) AS b FROM orders),
f AS (SELECT count(*)::BIGINT AS n, round((min(o_totalprice) + max(o_totalprice)) / 2000, 3) AS mid FROM orders WHERE o_orderstatus = 'F')
SELECT 'F-001' AS id, 'PASS' AS status, 'ok' AS reason, n AS rows, mean AS actual FROM o
UNION ALL SELECT 'F-002', 'FAIL', 'value_mismatch', n, mid FROM o
UNION ALL SELECT 'F-003', 'FAIL', 'value_mismatch', n, v FROM o
UNION ALL SELECT 'F-004', CASE WHEN b THEN 'PASS' ELSE 'FAIL' END, CASE WHEN b THEN 'ok' ELSE 'value_mismatch' END, n, round(b::INT / 1000, 3) FROM o
UNION ALL SELECT 'F-005', 'FAIL', 'measure_error', n, NULL FROM o
UNION ALL SELECT 'F-006', 'FAIL', 'value_mismatch', 0, NULL
UNION ALL SELECT 'F-007', 'FAIL', 'value_mismatch', 0, NULL
UNION ALL SELECT 'F-008', 'FAIL', 'row_count', n, mid FROM f"""


def q_rule_chain_row_all(spark, sf):
    """C3 in a chain: mask zeros, then keep rows whose discount and tax are
    there; rule application, attrition and evaluation agree."""
    reg = sc.registry(sf)
    reg.register_rule(rl.mask_equal("DR-301", "l_discount", 0.0))
    reg.register_rule(rl.keep_all("DR-302", ["l_discount", "l_tax"], lambda c: c >= 0))
    li, ids = _t(spark, sf, "lineitem"), ["DR-301", "DR-302"]
    chain = [reg.rules[i] for i in ids]
    rows, values = evaluate_groups(li, [(chain, None)], [reg.measures["mean_discount"]])
    parts = [rl.apply_rules(li, ids, reg).agg(F.count(F.lit(1)).alias("rows"), F.avg("l_discount").alias("mean"))
             .select(F.lit("applied").alias("how"), "rows", _r(F.col("mean")).alias("mean")),
             rl.attrition(li, ids, reg).where("step = 2").select(F.lit("attrition").alias("how"), "rows",
                                                                 F.lit(None).cast("double").alias("mean")),
             rows.join(values, "_g").select(F.lit("evaluated").alias("how"), "rows", _r(F.col("num")).alias("mean"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL_RULE_CHAIN_ROW_ALL = """
WITH k AS (SELECT count(*)::BIGINT AS rows, round(avg(l_discount), 6) AS mean FROM lineitem
           WHERE l_discount <> 0 AND l_discount >= 0 AND l_tax >= 0)
SELECT 'applied' AS how, rows, mean FROM k UNION ALL SELECT 'attrition', rows, NULL FROM k
UNION ALL SELECT 'evaluated', rows, mean FROM k"""


# ---------------------------------------------------------------- quotes without a locator, duplicated keys

def q_quote_corpus(spark, sf):
    """Quotes of 8 to 71 characters from every document, and the openings
    of every benchmark item, searched in all documents."""
    d = _t(spark, sf, "documents")
    k = F.col("doc_id")
    quotes = d.select(F.concat(F.lit("d-"), k.cast("string")).alias("quote_id"),
                      F.expr("substring(text, 31, cast(8 + doc_id % 64 as int))").alias("quote"))
    quotes = quotes.unionByName(_t(spark, sf, "benchmark").select(
        F.concat(F.lit("b-"), F.col("item_id").cast("string")).alias("quote_id"), F.substring("text", 1, 60).alias("quote")))
    return find_quotes(quotes, d.select(k.alias("locator"), "text"))


SQL_QUOTE_CORPUS = """
WITH RECURSIVE q AS (SELECT 'd-' || doc_id AS quote_id, substring(text, 31, 8 + doc_id % 64) AS quote FROM documents
           UNION ALL SELECT 'b-' || item_id, substring(text, 1, 60) FROM benchmark),
u AS (SELECT DISTINCT quote FROM q WHERE length(quote) > 0),
h AS (SELECT u.quote, d.doc_id AS locator, d.text FROM u JOIN documents d ON contains(d.text, u.quote)),
r AS (  -- from one occurrence to the next, which may overlap it
  SELECT quote, locator, text, strpos(text, quote) AS p, 1 AS n, strpos(text, quote) AS first_at FROM h
  UNION ALL SELECT quote, locator, text, p + strpos(substring(text, p + 1), quote), n + 1, first_at FROM r
  WHERE strpos(substring(text, p + 1), quote) > 0)
SELECT q.quote_id, r.locator, any_value(r.first_at - 1)::BIGINT AS first_at, max(r.n)::BIGINT AS occurrences
FROM q JOIN r USING (quote) GROUP BY 1, 2"""


def q_sentinel_profile(spark, sf):
    """Suspected sentinels in columns with seeded ones, and in clean ones."""
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    return pf.sentinel_profile(o.select(
        F.when(k % 7 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("price"), F.col("o_totalprice").alias("clean_price"),
        F.when(k % 11 == 0, F.lit("9999-12-31").cast("date")).otherwise(F.col("o_orderdate").cast("date")).alias("day"),
        F.col("o_orderdate").cast("date").alias("clean_day"), F.when(k % 5 == 0, 0).otherwise(F.col("o_custkey")).alias("customer"),
        F.col("o_custkey").alias("clean_customer"), F.when(k % 9 == 0, "").otherwise(F.concat(
            F.lit("customer "), F.col("o_custkey").cast("string"))).alias("name"), F.col("o_orderpriority").alias("priority"))
    ).select("column", "value", "n", _r(F.col("share")).alias("share"), "position")


SQL_SENTINEL_PROFILE = """
SELECT 'price' AS column, '-1.0' AS value, count(*) FILTER (WHERE o_orderkey % 7 = 0)::BIGINT AS n,
  round(count(*) FILTER (WHERE o_orderkey % 7 = 0) / count(*), 6) AS share, 'below' AS position FROM orders
UNION ALL SELECT 'day', '9999-12-31', count(*) FILTER (WHERE o_orderkey % 11 = 0),
  round(count(*) FILTER (WHERE o_orderkey % 11 = 0) / count(*), 6), 'above' FROM orders
UNION ALL SELECT 'customer', '0', count(*) FILTER (WHERE o_orderkey % 5 = 0 OR o_custkey = 0),
  round(count(*) FILTER (WHERE o_orderkey % 5 = 0 OR o_custkey = 0) / count(*), 6), 'usual' FROM orders
UNION ALL SELECT 'name', '', count(*) FILTER (WHERE o_orderkey % 9 = 0),
  round(count(*) FILTER (WHERE o_orderkey % 9 = 0) / count(*), 6), 'below' FROM orders"""


def q_duplicate_keys(spark, sf):
    """H6: duplicated composite keys with NULL parts, and the rows quarantined for them."""
    li = _t(spark, sf, "lineitem").withColumn("part", F.expr("nullif(l_partkey % 50, 0)")).withColumn(
        "supp", F.expr("nullif(l_suppkey % 7, 0)"))
    good, bad = quarantine_duplicates(li, ["l_orderkey", "supp"])
    n = lambda df, w: df.agg(F.count(F.lit(1)).alias("copies")).select(F.lit(w).alias("what"), F.lit(None).cast("long").alias("a"),
                                                                       F.lit(None).cast("long").alias("b"), "copies")
    keys = duplicate_keys(li, ["part", "supp"]).select(F.lit("key").alias("what"), F.col("part").cast("long").alias("a"),
                                                       F.col("supp").cast("long").alias("b"), "copies")
    return keys.unionByName(n(good, "good")).unionByName(n(bad, "bad"))


SQL_DUPLICATE_KEYS = """
WITH l AS (SELECT l_orderkey, nullif(l_partkey % 50, 0) AS part, nullif(l_suppkey % 7, 0) AS supp FROM lineitem),
c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, supp) AS n FROM l)
SELECT 'key' AS what, part::BIGINT AS a, supp::BIGINT AS b, count(*)::BIGINT AS copies FROM l
WHERE part IS NOT NULL OR supp IS NOT NULL GROUP BY part, supp HAVING count(*) > 1
UNION ALL SELECT 'good', NULL, NULL, count(*) FILTER (WHERE n = 1) FROM c
UNION ALL SELECT 'bad', NULL, NULL, count(*) FILTER (WHERE n > 1) FROM c"""


def q_flatten_records(spark, sf):
    """A3: nested JSON records without a given schema, one column per leaf."""
    o = _t(spark, sf, "orders")
    doc = F.to_json(F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderpriority").alias("priority")).alias("service"))
        .alias("customer"), F.array("o_orderstatus").alias("tags"),
        F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))).alias("extra"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("some")).alias("mixed"),
        F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderkey")).alias("number")))
    # one field that is text in some records and a number in others
    doc = F.regexp_replace(doc, '"number":', '"mixed":')
    flat = flatten_records(o.select(doc.alias("doc")), "doc")
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


SQL_FLATTEN_RECORDS = """
SELECT o_orderkey::BIGINT AS id, o_custkey::BIGINT AS customer_key, o_orderpriority AS customer_service_priority,
  '[' || coalesce('"' || o_orderstatus || '"', 'null') || ']' AS tags,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS extra_day,
  CASE o_orderkey % 4 WHEN 0 THEN 'some' WHEN 1 THEN o_orderkey::VARCHAR END AS mixed FROM orders"""


def q_sample_types(spark, sf):
    """B1: types and nulls of raw text columns."""
    o = _t(spark, sf, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return sample_types(o.select(
        k.cast("string").alias("key"), F.when(k % 40 == 0, "n/a").otherwise(k.cast("string")).alias("spoilt"),
        F.when(k % 7 == 0, " ").otherwise((k / 4).cast("string")).alias("quarter"),
        F.when(k % 5 == 0, k.cast("string")).otherwise((k / 8).cast("string")).alias("numbers"),
        F.when(k % 6 != 0, day).alias("day"), F.when(k % 2 == 0, day).otherwise(F.concat(day, F.lit(" 10:30:00"))).alias("time"),
        F.when(k % 2 == 0, "True").otherwise("false").alias("flag"), F.lit(None).cast("string").alias("nothing"),
        F.col("o_orderpriority").alias("words")))


SQL_SAMPLE_TYPES = """
WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS n7, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS n6,
  count(*) FILTER (WHERE trim(coalesce(o_orderpriority, '')) = '') AS nw FROM orders)
SELECT c AS "column", d AS dtype, n::BIGINT AS rows, m::BIGINT AS nulls, false AS sampled FROM (
  SELECT n, unnest(['key', 'spoilt', 'quarter', 'numbers', 'day', 'time', 'flag', 'nothing', 'words']) AS c,
    unnest(['integer', 'text', 'double', 'double', 'date', 'timestamp', 'boolean', 'null', 'text']) AS d,
    unnest([0, 0, n7, 0, n6, 0, 0, n, nw]) AS m FROM t)"""


def _build_graph(spark, sf):
    """Manifests raw day -> day -> month -> year -> report over the days of
    the events, and pairs of tables that are made from each other."""
    days = _t(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    level = lambda name, n: F.concat(F.lit(f"{name}/"), F.substring("day", 1, n))
    month = F.substring("day", 6, 2).cast("int")
    steps = [(level("daily", 10), level("raw", 10)), (level("monthly", 7), level("daily", 10)),
             (level("yearly", 4), level("monthly", 7)), (F.lit("report/all"), level("yearly", 4)),
             (F.when(month % 2 == 1, level("loop-a", 7)), level("loop-b", 7)),
             (F.when(month % 2 == 1, level("loop-b", 7)), level("loop-a", 7))]
    pairs = days.select(F.explode(F.array(*[F.struct(o.alias("output"), s.alias("source")) for o, s in steps])).alias("e")).select(
        "e.*").where("output IS NOT NULL").distinct()
    pin = lambda c: F.concat(F.lit("pin of "), c)
    manifests = pairs.groupBy("output").agg(F.map_from_entries(F.collect_list(F.struct("source", pin(F.col("source"))))).alias(
        "sources")).select(F.lit("events").alias("project"), "output", pin(F.col("output")).alias("output_sha256"), "sources",
                           F.lit("rules").alias("rules_fingerprint"))
    there = pairs.select(F.col("output").alias("path")).union(pairs.select("source")).distinct()
    changed = F.col("path").startswith("raw/") & (F.substring("path", -2, 2).cast("int") % 10 == 3)
    return materialize(manifests), there.select("path", F.when(changed, "other").otherwise(pin(F.col("path"))).alias("sha256"))


def q_lineage_closure(spark, sf):
    """G4 / G5 over several builds: what a changed raw day makes stale, and
    tables that were made from themselves."""
    manifests, current = _build_graph(spark, sf)
    return transitive_freshness(manifests, current, "rules", fast=False).unionByName(cycles(manifests))


SQL_LINEAGE_CLOSURE = """
WITH RECURSIVE d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events),
e AS (SELECT DISTINCT o, s FROM (
  SELECT 'monthly/' || day[1:7] AS o, 'daily/' || day AS s FROM d
  UNION ALL SELECT 'yearly/' || day[1:4], 'monthly/' || day[1:7] FROM d
  UNION ALL SELECT 'report/all', 'yearly/' || day[1:4] FROM d)),
r AS (SELECT 'daily/' || day AS p, 0 AS n FROM d WHERE day[9:10]::INT % 10 = 3
  UNION SELECT e.o, r.n + 1 FROM r JOIN e ON e.s = r.p),
l AS (SELECT DISTINCT day[1:7] AS m FROM d WHERE day[6:7]::INT % 2 = 1)
SELECT 'events' AS project, 'aggregate:freshness' AS "check", 'FAIL' AS severity, p AS finding_id,
  'made from a stale table ' || min(n) || ' build(s) before' AS detail FROM r GROUP BY p HAVING min(n) > 0
UNION ALL SELECT 'events', 'aggregate:lineage-cycle', 'FAIL', x || m, 'made from itself over 2 build(s)'
  FROM l, (VALUES ('loop-a/'), ('loop-b/')) AS v(x)"""


def q_daily_refresh(spark, sf):
    """A10: a build over an earlier state of the events, brought up to date:
    days that changed, came or went are told apart, the others are kept."""
    now = _t(spark, sf, "events").select("event_id", "user_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    dom = F.substring("day", 9, 2).cast("int")
    before = now.where(dom % 10 != 5).withColumn(
        "event_id", F.when(dom % 10 == 3, F.col("event_id") + 1).otherwise(F.col("event_id")))
    gone = now.where(dom % 10 == 7).withColumn("day", F.concat(F.lit("1999"), F.substring("day", 5, 6)))
    before = before.unionByName(gone)

    def build(made: str):
        return lambda df: df.groupBy("day").agg(
            F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"),
            F.sum("event_id").alias("sum_ids")).withColumn("made", F.lit(made))

    table, plan, _ = refresh(build("before")(before), now, pins(before, "day"), "day", build("now"))
    left = plan.where(F.col("action") != REMOVED)
    gone = plan.where(F.col("action") == REMOVED).select("day", "action")
    return (table.join(left, "day", "full_outer").select("day", "n_events", "n_users", "sum_ids", "made", "action")
            .unionByName(gone, allowMissingColumns=True))


SQL_DAILY_REFRESH = """
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, day(ts) % 10 AS dom FROM events)
SELECT day, count(*)::BIGINT AS n_events, count(DISTINCT user_id)::BIGINT AS n_users, sum(event_id)::BIGINT AS sum_ids,
  CASE WHEN any_value(dom) IN (3, 5) THEN 'now' ELSE 'before' END AS made,
  CASE any_value(dom) WHEN 3 THEN 'rebuilt' WHEN 5 THEN 'added' ELSE 'kept' END AS action FROM e GROUP BY day
UNION ALL SELECT DISTINCT '1999' || day[5:10], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, 'removed' FROM e WHERE dom = 7"""


# ---------------------------------------------------------------- registry

def _optional(name: str):
    """The module ``name``, or None where it isn't part of this checkout (a
    folder without its files has no origin)."""
    spec = find_spec(name)
    return import_module(name) if spec and spec.origin else None


#: The training-data operators live in a subpackage that may be absent.
_LLM = _optional("claimledger.llm") and import_module("claimledger.llm.queries")
_PIPELINE = _LLM and _optional("corpus_pipeline")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: replay the lineitem claims ledger at sf0.001."""
    return q_replay_lineitem(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **(_LLM.queries() if _LLM else {}),
        **({"pipeline": _PIPELINE.run} if _PIPELINE else {}),
        "scan_orders": q_scan_orders,
        "events_props": q_events_props,
        "sample_and_count": q_sample_and_count,
        "describe_lineitem": q_describe_lineitem,
        "first_orders": q_first_orders,
        "column_profile_orders": q_column_profile_orders,
        "domain_counts": q_domain_counts,
        "top_priorities": q_top_priorities,
        "all_zero_rows": q_all_zero_rows,
        "rule_drop_and_mask": q_rule_drop_and_mask,
        "row_all_any": q_row_all_any,
        "range_and_recode": q_range_and_recode,
        "attrition": q_attrition,
        "measures_lineitem": q_measures_lineitem,
        "quantiles_by_supplier": q_quantiles_by_supplier,
        "spearman_lineitem": q_spearman_lineitem,
        "confusion_labels": q_confusion_labels,
        "rate_by_event_type": q_rate_by_event_type,
        "replay_lineitem": q_replay_lineitem,
        "replay_summary": q_replay_summary,
        "ledger_checks": q_ledger_checks,
        "verdict": q_verdict,
        "content_fingerprint_orders": q_content_fingerprint_orders,
        "byte_fingerprint_lineitem": q_byte_fingerprint_lineitem,
        "source_sizes": q_source_sizes,
        "file_trees": q_file_trees,
        "daily_events": q_daily_events,
        "freshness_daily": q_freshness_daily,
        "lineage_daily": q_lineage_daily,
        "schema_drift_orders": q_schema_drift_orders,
        "quarantine_lineitem": q_quarantine_lineitem,
        "rule_sections": q_rule_sections,
        "rule_statuses": q_rule_statuses,
        "extract_ids": q_extract_ids,
        "placeholders": q_placeholders,
        "orphan_citations": q_orphan_citations,
        "trust_buckets": q_trust_buckets,
        "rule_caveat_sync": q_rule_caveat_sync,
        "caveat_register": q_caveat_register,
        "backlog_coverage": q_backlog_coverage,
        "rule_usage": q_rule_usage,
        "replay_keyed_customers": q_replay_keyed_customers,
        "claim_status": q_claim_status,
        "status_banner": q_status_banner,
        "action_items": q_action_items,
        "is_close_grid": q_is_close_grid,
        "tolerance_resolve": q_tolerance_resolve,
        "quote_checks": q_quote_checks,
        "quote_corpus": q_quote_corpus,
        "duplicate_keys": q_duplicate_keys,
        "sentinel_profile": q_sentinel_profile,
        "register_batch": q_register_batch,
        "next_ids": q_next_ids,
        "update_revisions": q_update_revisions,
        "scan_tree": q_scan_tree,
        "file_shapes": q_file_shapes,
        "json_array_ingest": q_json_array_ingest,
        "ledger_round_trip": q_ledger_round_trip,
        "load_manifests": q_load_manifests,
        "user_checks": q_user_checks,
        "validate_portfolio": q_validate_portfolio,
        "replay_isolated": q_replay_isolated,
        "replay_empty": q_replay_empty,
        "replay_python": q_replay_python,
        "rule_chain_row_all": q_rule_chain_row_all,
        "flatten_records": q_flatten_records,
        "sample_types": q_sample_types,
        "lineage_closure": q_lineage_closure,
        "daily_refresh": q_daily_refresh,
    }


def _nudge_rounds(sql: str) -> str:
    """Give every ``round(x, 6)`` the same 1e-12 relative nudge as ``_r``."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("round(")
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            k += 1
        inner = sql[j + len("round("):k]
        head, _, tail = inner.rpartition(",")
        inner = _nudge_rounds(inner)
        if tail.strip() == "6":
            head = _nudge_rounds(head)
            out.append(sql[i:j] + f"round(({head}) * 1.000000000001, 6)")
        else:
            out.append(sql[i:j] + f"round({inner})")
        i = k + 1


def oracle_sql() -> dict[str, str]:
    out = {k: _nudge_rounds(v) for k, v in _oracle_sql().items()}
    if _LLM:
        out |= _LLM.oracle_sql()
    if _PIPELINE and _PIPELINE.ORACLE_SQL:
        out["pipeline"] = _PIPELINE.ORACLE_SQL
    return out


def _oracle_sql() -> dict[str, str]:
    return {
        "scan_orders": SQL_SCAN_ORDERS,
        "events_props": SQL_EVENTS_PROPS,
        "sample_and_count": SQL_SAMPLE_AND_COUNT,
        "describe_lineitem": _sql_describe("lineitem", LINEITEM_COLS, LINEITEM_DOUBLES),
        "first_orders": SQL_FIRST_ORDERS,
        "column_profile_orders": _sql_profile("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
        "domain_counts": SQL_DOMAIN_COUNTS,
        "top_priorities": SQL_TOP_PRIORITIES,
        "all_zero_rows": SQL_ALL_ZERO_ROWS,
        "rule_drop_and_mask": SQL_RULE_DROP_AND_MASK,
        "row_all_any": SQL_ROW_ALL_ANY,
        "range_and_recode": SQL_RANGE_AND_RECODE,
        "attrition": SQL_ATTRITION,
        "measures_lineitem": SQL_MEASURES_LINEITEM,
        "quantiles_by_supplier": SQL_QUANTILES_BY_SUPPLIER,
        "spearman_lineitem": SQL_SPEARMAN_LINEITEM,
        "confusion_labels": SQL_CONFUSION_LABELS,
        "rate_by_event_type": SQL_RATE_BY_EVENT_TYPE,
        "replay_lineitem": SQL_REPLAY_LINEITEM,
        "replay_summary": SQL_REPLAY_SUMMARY,
        "ledger_checks": OL.checks_sql(_measure_names()),
        "verdict": OL.verdict_sql(_measure_names()),
        "content_fingerprint_orders": SQL_CONTENT_FINGERPRINT_ORDERS,
        "byte_fingerprint_lineitem": SQL_BYTE_FINGERPRINT,
        "source_sizes": SQL_SOURCE_SIZES,
        "daily_events": SQL_DAILY_EVENTS,
        "freshness_daily": SQL_FRESHNESS_DAILY,
        "lineage_daily": SQL_LINEAGE_DAILY,
        "flatten_records": SQL_FLATTEN_RECORDS,
        "sample_types": SQL_SAMPLE_TYPES,
        "lineage_closure": SQL_LINEAGE_CLOSURE,
        "daily_refresh": SQL_DAILY_REFRESH,
        "schema_drift_orders": SQL_SCHEMA_DRIFT_ORDERS,
        "quarantine_lineitem": SQL_QUARANTINE_LINEITEM,
        "rule_sections": SQL_RULE_SECTIONS,
        "rule_statuses": SQL_RULE_STATUSES,
        "extract_ids": SQL_EXTRACT_IDS,
        "placeholders": SQL_PLACEHOLDERS,
        "orphan_citations": _sql_orphans(),
        "trust_buckets": SQL_TRUST_BUCKETS,
        "rule_caveat_sync": SQL_RULE_CAVEAT_SYNC,
        "caveat_register": SQL_CAVEAT_REGISTER,
        "backlog_coverage": SQL_BACKLOG_COVERAGE,
        "rule_usage": _sql_rule_usage(sorted(sc.RULE_IDS)),
        "replay_keyed_customers": SQL_REPLAY_KEYED,
        "claim_status": SQL_CLAIM_STATUS,
        "status_banner": SQL_STATUS_BANNER,
        "action_items": SQL_ACTION_ITEMS,
        "is_close_grid": _sql_is_close_grid(),
        "tolerance_resolve": SQL_TOLERANCE_RESOLVE,
        "quote_checks": SQL_QUOTE_CHECKS,
        "quote_corpus": SQL_QUOTE_CORPUS,
        "duplicate_keys": SQL_DUPLICATE_KEYS,
        "sentinel_profile": SQL_SENTINEL_PROFILE,
        "register_batch": _sql_register_batch(_measure_names()),
        "next_ids": SQL_NEXT_IDS,
        "update_revisions": SQL_UPDATE_REVISIONS,
        "scan_tree": _sql_scan_tree(),
        "file_shapes": SQL_FILE_SHAPES,
        "json_array_ingest": SQL_JSON_ARRAY_INGEST,
        "ledger_round_trip": SQL_LEDGER_ROUND_TRIP,
        "load_manifests": SQL_LOAD_MANIFESTS,
        "user_checks": SQL_USER_CHECKS,
        "validate_portfolio": SQL_VALIDATE_PORTFOLIO,
        "replay_isolated": SQL_REPLAY_ISOLATED,
        "replay_empty": SQL_REPLAY_EMPTY,
        "replay_python": SQL_REPLAY_PYTHON,
        "rule_chain_row_all": SQL_RULE_CHAIN_ROW_ALL,
    }


def _measure_names() -> list[str]:
    return sorted(sc.MEASURE_NAMES)
