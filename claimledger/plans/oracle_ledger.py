"""DuckDB SQL for the orders-derived ledger: the expected violations are
computed directly from the rules that generate each finding (not from its
JSON), so the JSON-based checks are tested against independent logic."""

from __future__ import annotations

from claimledger import model as M

BASE = r"""
o AS (SELECT o_orderkey AS k, o_orderkey % 20 AS m, o_orderkey % 40 AS m40, o_custkey % 10 AS c10,
             o_totalprice, o_orderstatus, o_orderpriority FROM orders),
t0 AS (SELECT *, 'proj-' || c10 AS project,
        CASE WHEN m = 1 THEN 'X-' || k WHEN m = 2 THEN NULL WHEN m = 3 THEN printf('F-%06d', k - 3)
             ELSE printf('F-%06d', k) END AS id,
        CASE WHEN m = 4 THEN 'bogus'
             ELSE (['scalar', 'distribution', 'matrix', 'quote_provenance', 'proportion', 'rate', 'boolean',
                    'manual'])[k % 8 + 1] END AS ct
       FROM o),
t1 AS (SELECT *,
        CASE WHEN ct = 'manual' THEN 'notes.md:L1-L2' WHEN m = 5 THEN 'analysis/measures.py:L10-L20'
             WHEN m = 6 THEN 'nocolon' WHEN m = 7 THEN ':mean_totalprice' WHEN m = 8 THEN '../x.py:mean_totalprice'
             WHEN m = 9 THEN 'analysis/measures.py:123' WHEN m = 10 THEN 'analysis/measures.py:unknown_fn'
             ELSE 'analysis/measures.py:mean_totalprice' END AS cp,
        CASE WHEN m = 12 THEN 'MAYBE' WHEN k % 3 = 0 OR c10 = 0 THEN 'OBSERVED' WHEN k % 3 = 1 THEN 'PLAUSIBLE'
             ELSE 'WEAK' END AS tag,
        ct IN ('scalar', 'proportion', 'rate', 'boolean', 'distribution', 'matrix') AS replayable,
        CASE WHEN m = 16 AND c10 < 5 THEN 'loose' WHEN m = 17 AND c10 < 5 THEN 'scalar'
             WHEN m = 18 THEN 'object' ELSE 'none' END AS tol,
        CASE WHEN m = 19 AND c10 < 2 THEN 'bbb' WHEN k % 4 = 0 THEN 'aaa' END AS sha
       FROM t0),
t AS (SELECT *, contains(cp, ':') AS colon,
        regexp_replace(cp, ':[^:]*$', '') AS cp_file, regexp_extract(cp, '[^:]*$') AS suffix FROM t1)
"""


def _v(cond: str, check: str, severity: str, detail: str) -> str:
    return (f"SELECT project, '{check}' AS \"check\", '{severity}' AS severity, id AS finding_id, "
            f"{detail} AS detail FROM t WHERE {cond}")


def structural_sql(measure_names: list[str]) -> str:
    names = ", ".join(f"'{n}'" for n in measure_names)
    esc = r"(starts_with(cp_file, '/') OR regexp_matches(cp_file, '(^|/)\.\.(/|$)'))"
    line_ref = r"regexp_full_match(suffix, 'L\d+(-L?\d+)?')"
    ident = r"regexp_full_match(suffix, '[A-Za-z_][A-Za-z0-9_]*')"
    ok_file = f"colon AND cp_file <> '' AND NOT {esc}"
    parts = [
        _v("id IS NULL", "ids:present", M.FAIL, "'missing id'"),
        _v(f"id IS NOT NULL AND NOT regexp_matches(id, '{M.ID_PATTERN}')", "ids:format", M.FAIL, "id"),
        _v("m = 2", "schema:required", M.FAIL, "'id'"),
        _v("ct = 'bogus'", "check_type:valid", M.FAIL, "ct"),
        _v("ct IN ('scalar', 'proportion', 'rate') AND m = 11", "conditional:value", M.FAIL, "ct"),
        _v("ct = 'boolean' AND m = 11", "conditional:value", M.FAIL, "ct"),
        _v("ct = 'distribution' AND m = 11", "conditional:distribution", M.FAIL, "ct"),
        _v("ct = 'matrix' AND m = 11", "conditional:matrix", M.FAIL, "ct"),
        _v("ct = 'quote_provenance' AND m = 11", "conditional:quote", M.FAIL, "ct"),
        _v("tag = 'MAYBE'", "counterfactual:valid", M.FAIL, "tag"),
        _v("tag = 'OBSERVED' AND m = 13", "counterfactual:observed_needs_ref", M.FAIL, "'OBSERVED'"),
        _v("NOT colon", "code_path:form", M.FAIL, "cp"),
        _v("colon AND cp_file = ''", "code_path:nonempty", M.FAIL, "cp"),
        _v(f"colon AND cp_file <> '' AND {esc}", "code_path:escapes", M.FAIL, "cp"),
        _v(f"{ok_file} AND NOT {line_ref} AND {ident} AND suffix NOT IN ({names})",
           "code_path:resolves", M.FAIL, "cp"),
        _v(f"{ok_file} AND NOT {line_ref} AND NOT {ident}", "code_path:form", M.FAIL, "cp"),
        _v(f"{ok_file} AND {line_ref} AND replayable", "code_path:line_ref", M.FAIL, "cp"),
        _v("m40 = 27", "revision_history:nonempty", M.FAIL, "'empty'"),
        _v("m = 15", "caveats:list", M.FAIL, "'not a list'"),
        _v("m = 14", "caveats:empty", M.WARN, "'empty'"),
        _v("m40 = 23", "input:columns", M.FAIL, "'missing'"),
        _v("m40 = 22", "input:sources", M.FAIL, "'empty'"),
        _v("m40 = 21 AND replayable", "input:single_source", M.FAIL, "'2'"),
        _v("m40 = 26", "reproducibility:shape", M.FAIL, "'not an object'"),
        _v("m40 = 25", "reproducibility:filters", M.FAIL, "'not a list'"),
        _v("m40 = 24 AND replayable", "reproducibility:row_count", M.FAIL, "'missing'"),
        _v("tol = 'scalar'", "tolerance:shape", M.FAIL, "'not an object'"),
        _v("tol = 'loose'", "tolerance:loose", M.FAIL, "'abs'"),
    ]
    return "\nUNION ALL ".join(parts)


GROUP = r"""
SELECT project, 'ids:unique' AS "check", 'FAIL' AS severity, id AS finding_id,
       printf('duplicate id %s (%d copies)', id, count(*)) AS detail
FROM t WHERE id IS NOT NULL GROUP BY project, id HAVING count(*) > 1
UNION ALL
SELECT project, 'counterfactual:tag_distribution', 'WARN', NULL,
       printf('%d/%d are OBSERVED', count(*) FILTER (WHERE tag = 'OBSERVED'), count(*))
FROM t GROUP BY project
HAVING count(*) FILTER (WHERE tag = 'OBSERVED')::DOUBLE / count(*) > 0.6 AND count(*) > 5
UNION ALL
SELECT project, 'tolerance:custom', 'WARN', NULL,
       printf('%d finding(s) use a custom replay tolerance', count(*) FILTER (WHERE tol IN ('loose', 'object')))
FROM t GROUP BY project
HAVING count(*) FILTER (WHERE tol IN ('loose', 'object')) > 0 AND count(*) FILTER (WHERE tol IN ('loose', 'scalar')) = 0
UNION ALL
SELECT project, 'source_hash:consistency', 'FAIL', NULL, 'findings disagree on the fingerprint of orders'
FROM t WHERE m40 <> 22 GROUP BY project HAVING count(DISTINCT sha) > 1
UNION ALL
SELECT project, 'source_hash:unpinned', 'WARN', NULL,
       printf('%d input source(s) have no pinned fingerprint',
              count(*) FILTER (WHERE m40 <> 22 AND sha IS NULL) + count(*) FILTER (WHERE m40 = 21))
FROM t GROUP BY project
HAVING count(DISTINCT sha) FILTER (WHERE m40 <> 22) <= 1
   AND count(*) FILTER (WHERE m40 <> 22 AND sha IS NULL) + count(*) FILTER (WHERE m40 = 21) > 0
"""


def checks_sql(measure_names: list[str]) -> str:
    return f"WITH {BASE}\n{structural_sql(measure_names)}\nUNION ALL {GROUP}"


def verdict_sql(measure_names: list[str]) -> str:
    return f"""WITH {BASE}, v AS ({structural_sql(measure_names)} UNION ALL {GROUP}),
p AS (SELECT DISTINCT project FROM t)
SELECT p.project, count(v.severity) FILTER (WHERE v.severity = 'FAIL')::BIGINT AS failures,
       count(v.severity) FILTER (WHERE v.severity = 'WARN')::BIGINT AS warnings,
       CASE WHEN count(v.severity) FILTER (WHERE v.severity = 'FAIL') > 0 THEN 1 ELSE 0 END AS exit_code
FROM p LEFT JOIN v ON p.project = v.project GROUP BY p.project"""
