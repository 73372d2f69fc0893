"""Admission of document files, and the text layer of simple PDF files. Input: name, mime, size, content (binary) and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import SPACE, strip

#: Limits of a file, and of the text that is read from one.
MOST_BYTES, HEADER_BYTES, MOST_PIECES, LEAST_TEXT = 12 * 1024 * 1024, 8192, 2000, 20
MOST_PAGES, PAYSLIP_PAGES = 10, 3
KINDS = ("payslip", "pensionReport")
PAYSLIP_SIGNS = "(?i)insured\\s*salary|gross\\s*salary|employee\\s*contribution|שכר\\s*(מבוטח|ברוטו)|תגמולי\\s*עובד".replace("\\s", SPACE)
REPORT_SIGNS = "(?i)current\\s*balance|balance\\s*fee|annual\\s*report|יתרה\\s*(נוכחית|לסוף)|דמי\\s*ניהול|דוח\\s*שנתי".replace("\\s", SPACE)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files of a folder as gate() takes them; content is read only where a column needs it."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("mime"), F.col("length").alias("size"), "content", F.lit(kind).alias("kind"))


def gate() -> Column:
    """Why a file isn't read (unknown-kind, unsupported-type, file-too-large, manual-required, corrupted-pdf, password-protected); null if it is."""
    mime = F.lower(F.coalesce("mime", F.lit("")))
    pdf = (mime == "application/pdf") | ((mime == "") & F.coalesce(F.col("name"), F.lit("")).rlike("(?i)\\.pdf$"))
    image = (F.col("kind") == "pensionReport") & mime.isin("image/jpeg", "image/png")
    header = F.decode(F.substring("content", 1, HEADER_BYTES), "ISO-8859-1")
    return (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown-kind")
        .when(~pdf & ~image, "unsupported-type")
        .when(F.col("size") > MOST_BYTES, "file-too-large")
        .when(~pdf, "manual-required")
        .when(~F.coalesce(F.contains(header, F.lit("%PDF")), F.lit(False)), "corrupted-pdf")
        .when(header.rlike("/Encrypt(?![A-Za-z0-9_])"), "password-protected")
    )


def literal_text(content: Column) -> Column:
    """The strings that a PDF file shows with Tj and that aren't compressed, a line each."""
    raw = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit("\\(([^()]{2,240})\\)" + SPACE + "*Tj"), F.lit(1))
    plain = lambda s: F.regexp_replace(F.regexp_replace(s, "\\\\([()\\\\])", "$1"), "\\\\n", " ")
    return strip(F.regexp_replace(F.array_join(F.transform(F.slice(raw, 1, MOST_PIECES), plain), "\n"), "[ \\t]+", " "))


def wrong_document(text: Column, kind: Column) -> Column:
    """Whether a text has the signs of the other kind of document, and none of its own."""
    payslip, report = text.rlike(PAYSLIP_SIGNS), text.rlike(REPORT_SIGNS)
    return F.when(kind == "payslip", report & ~payslip).otherwise(payslip & ~report)


def error_status(name: Column, message: Column) -> Column:
    """The status of a file that a reader failed on, from the error's name and message."""
    name, message = F.coalesce(name, F.lit("")), F.coalesce(message, F.lit(""))
    return (
        F.when(name == "AbortError", "cancelled")
        .when(name.rlike("(?i)PasswordException") | message.rlike("(?i)password"), "password-protected")
        .when(name.rlike("(?i)InvalidPDFException|MissingPDFException") | message.rlike("(?i)invalid pdf|pdf structure"), "corrupted-pdf")
        .otherwise("unreadable-pdf")
    )


def text_status(text: Column, kind: Column) -> Column:
    """Why a file's text isn't parsed (no-useful-text, wrong-document); null if it is."""
    return F.when(F.length(text) < LEAST_TEXT, "no-useful-text").when(wrong_document(text, kind), "wrong-document")
