"""Ledger storage and ingest (A4, A5).

Storage form: one finding per row, a JSON object in column ``doc`` plus the
``project`` it belongs to.  That form splits across any number of files and
tasks.  A ledger that arrives as one JSON array per file is ingested as whole
text per file (the array is one document), parsed with ``try_parse_json`` and
split into elements; every defect becomes a violation row, never a crash.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimledger import model as M
from claimledger.session import materialize


def _v(path: str) -> Column:
    return F.expr(f"variant_get(v, '{path}', 'variant')")


def vtype(path: str) -> Column:
    """Type tag of a JSON path: NULL when absent, 'VOID' for JSON null,
    else 'OBJECT<..>', 'ARRAY<..>', 'STRING', 'BOOLEAN', 'BIGINT', 'DECIMAL(..)',
    'DOUBLE'."""
    return F.expr(f"schema_of_variant(variant_get(v, '{path}', 'variant'))")


def is_object(t: Column) -> Column:
    return F.coalesce(t.startswith("OBJECT"), F.lit(False))


def is_array(t: Column) -> Column:
    return F.coalesce(t.startswith("ARRAY"), F.lit(False))


def is_number(t: Column) -> Column:
    return F.coalesce(t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def get(path: str, typ: str) -> Column:
    return F.expr(f"try_variant_get(v, '{path}', '{typ}')")


def parse(ledger: DataFrame) -> DataFrame:
    """(project, doc) -> (project, doc, v) with v = VARIANT or NULL when the
    document is not valid JSON."""
    return ledger.withColumn("v", F.expr("try_parse_json(doc)"))


def read_json_array_files(spark: SparkSession, path: str, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A4 for array-per-file ledgers: returns (ledger rows, violations).

    Each file must parse, be an array, and each element an object; a bad
    element is reported by position and the good ones are kept.
    """
    raw = (spark.read.text(path, wholetext=True)
           .select(F.coalesce(F.lit(project), F.input_file_name()).alias("project"),
                   F.col("value").alias("text")))
    return split_json_arrays(raw)


def split_json_arrays(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project, text) holding one JSON array each -> (ledger, violations)."""
    parsed = raw.withColumn("v", F.expr("try_parse_json(text)")).withColumn(
        "t", F.expr("schema_of_variant(v)"))
    elems = parsed.where(is_array(F.col("t"))).select(
        "project", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("pos", "e"))
    elems = elems.withColumn("et", F.expr("schema_of_variant(e)"))
    ledger = elems.where(is_object(F.col("et"))).select(
        "project", F.expr("to_json(e)").alias("doc"))
    bad_doc = parsed.where(F.col("v").isNull()).select(
        "project", F.lit("ledger:parses").alias("check"), F.lit(M.FAIL).alias("severity"),
        F.lit(None).cast("string").alias("finding_id"),
        F.lit("ledger text is not valid JSON").alias("detail"))
    bad_shape = parsed.where(F.col("v").isNotNull() & ~is_array(F.col("t"))).select(
        "project", F.lit("ledger:shape").alias("check"), F.lit(M.FAIL).alias("severity"),
        F.lit(None).cast("string").alias("finding_id"),
        F.lit("expected a top-level array").alias("detail"))
    bad_elem = elems.where(~is_object(F.col("et"))).select(
        "project", F.lit("ledger:shape").alias("check"), F.lit(M.FAIL).alias("severity"),
        F.lit(None).cast("string").alias("finding_id"),
        F.format_string("element %d is not a JSON object", F.col("pos")).alias("detail"))
    return ledger, bad_doc.unionByName(bad_shape).unionByName(bad_elem)


def document_violations(ledger: DataFrame) -> DataFrame:
    """A4 for the row form: rows whose ``doc`` is not valid JSON or not an
    object."""
    p = parse(ledger) if "v" not in ledger.columns else ledger
    t = F.expr("schema_of_variant(v)")
    return p.where(F.col("v").isNull() | ~is_object(t)).select(
        "project",
        F.when(F.col("v").isNull(), F.lit("ledger:parses")).otherwise(F.lit("ledger:shape")).alias("check"),
        F.lit(M.FAIL).alias("severity"), F.lit(None).cast("string").alias("finding_id"),
        F.when(F.col("v").isNull(), F.lit("finding is not valid JSON"))
         .otherwise(F.lit("every finding must be a JSON object")).alias("detail"))


def typed(ledger: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Typed view of well-formed findings (objects only), used by replay,
    registration and status.  ``carry`` columns are passed through."""
    p = parse(ledger) if "v" not in ledger.columns else ledger
    # Non-objects keep a NULL variant (all fields NULL) instead of being
    # filtered: a filter on ``v`` is pushed below the parse and copies its
    # whole expression, which grows the plan with every parse/serialise
    # round trip.  Such rows are reported by ``document_violations``.
    p = p.withColumn("v", F.when(is_object(F.expr("schema_of_variant(v)")), F.col("v")))
    code_path = get("$.code_path", "string")
    vt = vtype("$.value")
    tol_t = vtype("$.tolerance")
    sources = get("$.input.sources", "array<struct<path:string,sha256:string>>")
    return p.select(
        *(carry or []),
        "project",
        get("$.id", "string").alias("id"),
        get("$.claim", "string").alias("claim"),
        F.expr("variant_get(v, '$.value', 'variant')").alias("value_v"),
        get("$.n", "bigint").alias("n"),
        get("$.check_type", "string").alias("check_type"),
        code_path.alias("code_path"),
        F.when(code_path.contains(":"), F.substring_index(code_path, ":", -1)).alias("measure"),
        F.when(is_number(vt), get("$.value", "double")).alias("value_num"),
        F.when(vt == "BOOLEAN", get("$.value", "boolean")).alias("value_bool"),
        F.when(vt == "STRING", get("$.value", "string")).alias("value_str"),
        get("$.distribution", "map<string,double>").alias("distribution"),
        get("$.matrix", "array<array<double>>").alias("matrix"),
        get("$.quote", "string").alias("quote"),
        get("$.source_locator", "string").alias("source_locator"),
        F.coalesce(F.size(sources), F.lit(0)).alias("n_sources"),
        sources.alias("sources"),
        sources[0]["path"].alias("source"),
        sources[0]["sha256"].alias("source_sha256"),
        get("$.input.columns", "array<string>").alias("columns"),
        F.coalesce(get("$.reproducibility.filters", "array<string>"),
                   F.array().cast("array<string>")).alias("filters"),
        get("$.reproducibility.row_count_after_filter", "bigint").alias("row_count"),
        get("$.caveats", "array<string>").alias("caveats"),
        get("$.counterfactual_tag", "string").alias("tag"),
        get("$.measurement_ref", "string").alias("measurement_ref"),
        F.when(is_object(tol_t), get("$.tolerance.abs", "double")).alias("tol_abs"),
        F.when(is_object(tol_t), get("$.tolerance.rel", "double")).alias("tol_rel"),
        get("$.revision_history", "array<struct<timestamp:string,reason:string>>").alias("revision_history"),
        get("$.decisions", "array<string>").alias("decisions"),
        get("$.addresses", "array<string>").alias("addresses"),
        get("$.group_by", "string").alias("group_by"),
        get("$.group_key", "string").alias("group_key"),
        (F.col("doc") if "doc" in p.columns else F.expr("to_json(v)")).alias("doc"),
    )


def write_ledger(ledger: DataFrame, root: str) -> str:
    """A5: write a new immutable version, then publish it by a new numbered
    pointer; nothing is overwritten.  Documents that are not JSON objects and
    non-finite numbers anywhere in value, distribution or matrix are rejected
    before writing.

    Returns the version path.  Readers follow the highest pointer; a failed
    job leaves the version before it published.
    """
    spark = ledger.sparkSession
    stored = materialize(ledger.select("project", "doc"))  # checked and written from text that is computed once
    infinite = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    # one aggregate, no filter: a filter is pushed below the parse and repeats it for every field it reads
    t = typed(parse(stored).withColumn("_object", is_object(F.expr("schema_of_variant(v)"))), ["_object"])
    found = t.agg(F.count_if(~F.col("_object")).alias("others"),
                  F.count_if(infinite(F.col("value_num")) | F.exists(F.map_values("distribution"), infinite)
                             | F.exists("matrix", lambda row: F.exists(row, infinite))).alias("infinite")).first()
    if found["others"]:
        raise ValueError("every document must be a JSON object")
    if found["infinite"]:
        raise ValueError("numbers must be finite (no NaN/Inf)")
    root = root.rstrip("/")
    version = f"{root}/version={uuid.uuid4().hex}"
    stored.write.mode("error").parquet(version)
    last = _pointers(spark, root)
    n = (last[0][0] if last else 0) + 1
    spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("error").text(f"{root}/pointers/n={n}")
    return version


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version path), the highest first; at most one row is read."""
    try:
        found = spark.read.schema("value string, n long").text(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [(r["n"], r["value"]) for r in found.orderBy(F.desc("n")).limit(1).collect()]


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    last = _pointers(spark, root.rstrip("/"))
    if not last:
        raise FileNotFoundError(f"no ledger is published in {root}")
    return spark.read.parquet(last[0][1])


def _null_if_empty_struct(fields: list[Column], names: list[str]) -> Column:
    any_set = F.lit(False)
    for f in fields:
        any_set = any_set | f.isNotNull()
    return F.when(any_set, F.struct(*[f.alias(n) for f, n in zip(fields, names)]))


#: Fields that the typed view always decides, also by leaving them out.
_REPLACED = ["value", "distribution", "matrix", "input", "reproducibility", "revision_history"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row: as the variable of a
    lambda it isn't repeated where ``body`` or a lambda in it uses it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fields(parsed: Column, path: str = "$") -> Column:
    """Fields of a VARIANT object as map<string, variant>; empty if it is none."""
    v = F.call_function("try_variant_get", parsed, F.lit(path), F.lit("map<string,variant>"))
    return F.coalesce(v, F.expr("cast(map() as map<string,variant>)"))


def _parsed(json: Column) -> Column:
    return F.call_function("try_parse_json", json)


def _overlay(base: Column, over: Column, drop: list[str] | None = None) -> Column:
    """Fields of ``over``, and of ``base`` those that ``over`` lacks."""
    return _let(over, lambda o: F.map_concat(
        F.map_filter(base, lambda k, _: ~F.map_contains_key(o, k) & ~k.isin(drop or [""])), o))


def merge_documents(base: Column, change: Column, keep: list[str]) -> Column:
    """The document ``base`` with the fields of ``change``, but for ``keep``."""
    changed = F.map_filter(_fields(_parsed(change)), lambda k, _: ~k.isin(keep))
    return F.to_json(_overlay(_fields(_parsed(base)), changed))


def to_document(t: DataFrame) -> DataFrame:
    """Typed view -> (project, id, doc).  Absent (NULL) fields are omitted.

    The typed fields are laid over the document that the view came from
    (column ``doc``), so fields that the view doesn't know stay, also inside
    input, its sources and reproducibility.
    """
    if "doc" not in t.columns:
        t = t.withColumn("doc", F.lit(None).cast("string"))
    value = F.coalesce(F.col("value_v"),
                       F.when(F.col("value_bool").isNotNull(), F.col("value_bool").cast("variant")),
                       F.when(F.col("value_num").isNotNull(), F.col("value_num").cast("variant")),
                       F.when(F.col("value_str").isNotNull(), F.col("value_str").cast("variant")))
    known = F.to_json(F.struct(
        F.col("id"), F.col("claim"), F.col("check_type"), F.col("code_path"),
        value.alias("value"), F.col("distribution"), F.col("matrix"), F.col("quote"),
        F.col("source_locator"), F.col("n"),
        F.col("caveats"), F.col("tag").alias("counterfactual_tag"), F.col("measurement_ref"),
        _null_if_empty_struct([F.col("tol_abs"), F.col("tol_rel")], ["abs", "rel"]).alias("tolerance"),
        F.col("revision_history"), F.col("decisions"), F.col("addresses"),
        F.col("group_by"), F.col("group_key")))
    pinned = F.transform("sources", lambda s: F.struct(s["path"].alias("path"), s["sha256"].alias("sha256")))
    inputs = lambda sources: F.to_json(F.struct(
        sources.alias("sources"), F.coalesce(F.col("columns"), F.array().cast("array<string>")).alias("columns")))
    repro = F.to_json(F.struct(F.col("filters"), F.col("row_count").alias("row_count_after_filter")))

    def document(v: Column) -> Column:
        before = F.call_function("try_variant_get", v, F.lit("$.input.sources"), F.lit("array<map<string,variant>>"))
        fresh = F.transform(pinned, lambda s: _fields(_parsed(F.to_json(s))))
        sources = _let(before, lambda b: _let(fresh, lambda f: F.when(F.size(b) == F.size(f), F.zip_with(
            b, f, lambda x, y: _overlay(x, y, ["sha256"]))).otherwise(f)))
        part = lambda path, json: _parsed(F.to_json(
            _overlay(_fields(v, path), _fields(_parsed(json)), ["row_count_after_filter"])))
        nested = F.create_map(F.lit("input"), part("$.input", inputs(sources)),
                              F.lit("reproducibility"), part("$.reproducibility", repro))
        return F.to_json(_overlay(_fields(v), F.map_concat(_fields(_parsed(known)), nested), _REPLACED))

    doc = _let(_parsed(F.col("doc")), document)
    return t.select("project", "id", doc.alias("doc"))
