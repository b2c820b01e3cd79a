"""Quote provenance (D7): a quote must occur verbatim in its located source.

The locator names a document of the corpus (``doc:L10-L20`` -> ``doc``); a
locator that is not in the corpus fails.  Claims join the corpus on the
locator (an equi-join); only quote claims take part in it, so claims of other
types never pile up on a NULL join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger import model as M


def locator_key(c):
    return F.substring_index(c, ":", 1)


def verify_quotes(claims: DataFrame, corpus: DataFrame, locator_col: str = "source_locator",
                  quote_col: str = "quote") -> DataFrame:
    """claims + ``quote_reason`` (ok / quote_missing / locator_outside_corpus /
    quote_not_found).  ``corpus`` has columns (locator, text)."""
    q = claims.withColumn("_loc", locator_key(F.col(locator_col)))
    docs = corpus.select(F.col("locator").alias("_c_loc"), F.col("text").alias("_c_text"))
    j = q.join(docs, q["_loc"] == docs["_c_loc"], "left")
    quote = F.col(quote_col)
    reason = (F.when(F.coalesce(quote, F.lit("")) == "", F.lit(M.R_QUOTE_MISSING))
               .when(F.coalesce(F.col(locator_col), F.lit("")) == "", F.lit(M.R_QUOTE_MISSING))
               .when(F.col("_c_loc").isNull(), F.lit(M.R_LOCATOR))
               .when(F.instr(F.col("_c_text"), quote) > 0, F.lit(M.R_OK))
               .otherwise(F.lit(M.R_QUOTE_NOT_FOUND)))
    return j.withColumn("quote_reason", reason).drop("_loc", "_c_loc", "_c_text")


def quote_reasons(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    is_q = F.col("check_type") == "quote_provenance"
    q = verify_quotes(claims.where(is_q), corpus)
    rest = claims.where(~is_q | F.col("check_type").isNull()).withColumn(
        "quote_reason", F.lit(None).cast("string"))
    return q.unionByName(rest)
