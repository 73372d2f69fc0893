"""From a document file to its fields: admission, page limit, kind, the text layer, a second reading in token order, recognised pages.

Input: doc_id, name, mime, size, content, kind (files.gate's columns), page_count, text and pages of the text layer, ocr_pages of a recogniser; pages are
arrays of page_number, tokens, blocks as tokens.of_document reads them. Opening and rasterising PDF files is left to whoever fills these columns. Each document takes one
way and has one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import layout, payslip, provenance, report
from tidewright.session import merged, settled
from tidewright.sources import files, tokens
from tidewright.streaming import pages as paged

#: The type of a recogniser's pages as JSON: blocks of paragraphs, lines, words and symbols, each with its box and confidence.
_BOX = "bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double"
PAGES = f"array<struct<page_number:int,tokens:array<struct<text:string,x:double,y:double,width:double,height:double,{_BOX}>>,blocks:array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,{_BOX},symbols:array<struct<text:string,{_BOX}>>>>>>>>>>>>"


def recorded_pages(raw: F.Column) -> F.Column:
    """Pages that a recogniser's output records as JSON; null where it can't be read."""
    return F.from_json(raw, PAGES)


def _with_text(found: DataFrame) -> DataFrame:
    """doc_id and the rows of a document's tokens as lines of text."""
    rows = layout.build_rows(found).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "direct_text"))).alias("rows"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["direct_text"]), "\n").alias("text"))


def _in_order(found: DataFrame) -> DataFrame:
    """doc_id and a document's tokens, one a line, as they come."""
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return listed.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def reports(docs: DataFrame) -> DataFrame:
    """Fields of reports (doc_id, text, pages) whose text layer is useful: from its rows as text, fees from the tokens' places."""
    useful = docs.filter(provenance.assess_text(F.col("text"), "pensionReport")["useful"])
    found = settled(tokens.of_document(useful))
    lines = settled(_with_text(found))
    return report.with_token_fees(report.parse(tokens.of_document(lines), lines), found)


def payslips(docs: DataFrame) -> DataFrame:
    """Fields of payslips (doc_id, text, pages) from their text layer; where no salary is found, from its tokens one by one if they give one."""
    found = settled(tokens.of_document(docs))
    first = settled(payslip.parse_with_fallback(found, docs.select("doc_id", "text")).drop("stream"))
    salary = lambda fields: fields.filter("name = 'insuredSalary'").select("doc_id")
    unread = settled(_in_order(found.join(merged(salary(first)), "doc_id", "left_anti")))
    if unread.isEmpty():
        return first
    again = settled(payslip.parse(tokens.of_document(unread)))
    better = salary(again)
    return first.join(merged(better), "doc_id", "left_anti").unionByName(again.join(merged(better), "doc_id", "left_semi"))


def scans(docs: DataFrame) -> DataFrame:
    """Fields of payslips from recognised pages (doc_id, ocr_pages): of the first pages that have a salary and a contribution, else of all that count."""
    found = settled(tokens.of_document(docs.select("doc_id", F.lit(None).cast("string").alias("text"), F.col("ocr_pages").alias("pages"))).filter(F.col("page") <= files.PAYSLIP_PAGES))
    enough = settled(paged.first_sufficient_page(found, files.PAYSLIP_PAGES)).select(F.col("doc_id").alias("key"), F.col("page").alias("last"))
    used = found.withColumn("key", F.col("doc_id").cast("string")).join(merged(enough), "key", "left").filter("last is null or page <= last").drop("key", "last")
    return payslip.parse(settled(used), ocr=True)


def extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (doc_id, kind, status, reason, method, identified, classification) of all documents, and fields (doc_id, name, field: an envelope) of those with status partial.

    status is a gate()'s, too-many-pages, wrong-document, partial (any field was found), page-limit (a payslip of more pages than are read), or manual-required.
    """
    kind = F.col("kind")
    most = F.when(kind == "payslip", files.PAYSLIP_PAGES).otherwise(files.MOST_PAGES)
    read = F.filter("pages", lambda p: F.coalesce(p["page_number"], F.lit(1)) <= most)
    seen = docs.withColumns({"gate": files.gate(), "text": F.coalesce("text", F.lit("")), "pages": read, "most": most})
    early = F.coalesce("gate", F.when(F.col("page_count") > files.MOST_PAGES, "too-many-pages").when(files.wrong_document(F.col("text"), kind), "wrong-document"))
    judged = F.when(F.col("early").isNull(), F.col("text"))
    assessed = F.when(kind == "payslip", provenance.assess_text(judged, "payslip")["reason"]).otherwise(provenance.assess_text(judged, "pensionReport")["reason"])
    seen = settled(seen.withColumn("early", early).withColumn("assessed", assessed).drop("content"))
    open_ = seen.filter("early is null")
    slips, sheets = open_.filter("kind = 'payslip'"), open_.filter("kind = 'pensionReport'")

    native = settled(provenance.wrap(slips.select("doc_id"), payslips(slips.select("doc_id", "text", "pages")), "payslip"))
    counts = settled(provenance.identified_count(native))
    poor = counts.filter("identified = 0").select("doc_id")
    scanned = slips.join(merged(poor), "doc_id").select("doc_id", "ocr_pages")
    recognised = settled(provenance.wrap(scanned.select("doc_id"), scans(scanned), "payslip"))
    printed = settled(provenance.wrap(sheets.select("doc_id"), reports(sheets.select("doc_id", "text", "pages")), "pensionReport"))
    fields = native.join(merged(poor), "doc_id", "left_anti").withColumn("method", F.lit("pdf-text"))
    fields = settled(fields.unionByName(recognised.withColumn("method", F.lit("ocr"))).unionByName(printed.withColumn("method", F.lit("pdf-text"))))

    found = provenance.identified_count(fields.select("doc_id", "field")).drop("status").join(merged(fields.groupBy("doc_id").agg(F.first("method").alias("method"))), "doc_id")
    out = seen.join(merged(found), "doc_id", "left").withColumn("identified", F.coalesce("identified", F.lit(0)).cast("long"))
    late = F.when(F.col("identified") > 0, "partial").when((kind == "payslip") & (F.col("page_count") > F.col("most")), "page-limit").otherwise("manual-required")
    status = F.coalesce("early", late)
    reason = F.when(F.col("early") == "too-many-pages", "page-count-limit").when(F.col("early") == "wrong-document", "document-signals-mismatch").when(F.col("early").isNull(), F.when((kind == "payslip") & (F.col("method") == "pdf-text"), "native-text-usable").otherwise(F.col("assessed")))
    method = F.when(F.col("early") == "wrong-document", "pdf-text").otherwise(F.col("method"))
    label = F.when((kind == "pensionReport") & (status == "partial"), report.classification(F.col("text")))
    results = out.select("doc_id", "kind", status.alias("status"), reason.alias("reason"), method.alias("method"), "identified", label.alias("classification"))
    return results, fields.join(merged(results.filter("status = 'partial'").select("doc_id")), "doc_id", "left_semi").select("doc_id", "name", "field")
