"""Text extraction over a corpus of documents.

Registers (decisions, backlog, trust memo, caveats) are just documents; a
corpus is a DataFrame (doc_id, text).  A document is one row, and its parts
are found with array functions inside the row: no shuffle before the
aggregates that span documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger import model as M


def parts(text: Column, is_head) -> Column:
    """Array of (pos, head, body): the lines for which ``is_head`` holds, each
    with its position and the lines up to the next one, joined."""
    # each array is bound to a lambda variable: written in place it would be built again for every element
    bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)

    def cut(ln, heads):
        end = lambda k: F.coalesce(F.get(heads, k + 1), F.size(ln))
        return F.transform(heads, lambda p, k: F.struct(
            p.alias("pos"), F.get(ln, p).alias("head"),
            F.array_join(F.slice(ln, p + 2, end(k) - p - 1), "\n").alias("body")))

    def found(ln):
        at = F.transform(ln, lambda x, i: F.when(is_head(x), i))
        return bound(F.filter(at, lambda i: i.isNotNull()), lambda heads: cut(ln, heads))

    return bound(F.split(text, "\n", -1), found)


def sections(docs: DataFrame, id_regex: str, doc_col: str = "doc_id", text_col: str = "text",
             level: str = "###", carry: list[str] | None = None) -> DataFrame:
    """(doc, id, title, body, pos) for every ``<level> <id> — <title>``
    heading; the body runs to the next heading of that level."""
    carry = carry or []
    any_head, head = M.any_heading(level), M.id_heading(level, id_regex)
    s = docs.select(*carry, F.col(doc_col).alias("doc"), F.inline(parts(F.col(text_col), lambda x: x.rlike(any_head))))
    return s.where(F.col("head").rlike(head)).select(
        *carry, "doc", F.regexp_extract("head", head, 1).alias("id"), F.regexp_extract("head", head, 2).alias("title"),
        "body", "pos")


def field(body: Column, name: str) -> Column:
    """The value of a ``**Name:** value`` line (first occurrence)."""
    v = F.regexp_extract(body, M.field_line(name), 1)
    return F.when(body.contains(f"**{name}:**"), F.trim(v))


def rule_statuses(docs: DataFrame, id_regex: str = r"DR-\d+", doc_col: str = "doc_id",
                  text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, status): lower-cased ``**Status:**`` of each ``##``/``###``
    rule heading, 'unknown' when absent; for a rule stated several times the
    last statement (by document, then position) wins."""
    carry = carry or []
    head = rf"^#{{2,3}}\s+({id_regex})\b"
    p = docs.select(*carry, F.col(doc_col).alias("doc"), F.inline(parts(F.col(text_col), lambda x: x.rlike(head))))
    p = p.select(*carry, F.regexp_extract("head", head, 1).alias("id"), F.struct("doc", "pos").alias("_at"),
                 F.lower(F.try_element_at(F.regexp_extract_all("body", F.lit(M.STATUS_IN_TEXT), 1), F.lit(-1))).alias("_st"))
    g = p.groupBy(*carry, "id").agg(F.max_by("_st", F.when(F.col("_st").isNotNull(), F.col("_at"))).alias("status"))
    return g.select(*carry, "id", F.coalesce("status", F.lit("unknown")).alias("status"))


def extract_ids(docs: DataFrame, pattern: str, doc_col: str = "doc_id", text_col: str = "text",
                distinct: bool = True) -> DataFrame:
    """T4: (doc, id) for every match of ``pattern`` in the whole text."""
    out = docs.select(F.col(doc_col).alias("doc"),
                      F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("id"))
    return out.distinct() if distinct else out


def unfilled_placeholders(docs: DataFrame, token: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T5: (doc, occurrences) for documents still holding a literal token;
    a non-empty result means "not ready"."""
    n = (F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit(token), F.lit("")))) \
        / F.lit(len(token))
    return docs.where(F.col(text_col).contains(token)).select(
        F.col(doc_col).alias("doc"), n.cast("long").alias("occurrences"))
