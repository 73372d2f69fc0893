"""Documents that arrive page by page: the first page after which the pages so far hold what is asked for.

The reader stops early; as a table, each prefix of a document's pages is a document of its own, and the least one that
satisfies counts. It's a batch computation: nothing here depends on arrival times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import payslip
from tidewright.session import merged


def prefixes(tokens: DataFrame, most_pages: int) -> DataFrame:
    """tokens once for each prefix of its document's first pages; prefix is the last page in it, and doc_id names both."""
    upto = F.explode(F.sequence(F.col("page"), F.lit(most_pages)))
    pages = tokens.groupBy("doc_id").agg(F.least(F.max("page"), F.lit(most_pages)).alias("last"))
    rows = tokens.filter(F.col("page") <= most_pages).withColumn("prefix", upto).join(merged(pages), "doc_id").filter("prefix <= last")
    return rows.withColumn("doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("prefix").cast("string")))


def first_sufficient_page(tokens: DataFrame, most_pages: int = 3, ocr: bool = True) -> DataFrame:
    """doc_id (as text) and the first page with which a salary and a contribution are known."""
    done = payslip.has_critical(payslip.parse(prefixes(tokens, most_pages), ocr))
    parts = F.split("doc_id", "#")
    return done.select(parts[0].alias("doc_id"), parts[1].cast("int").alias("page")).groupBy("doc_id").agg(F.min("page").alias("page"))
