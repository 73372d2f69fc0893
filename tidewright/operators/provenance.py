"""Extracted fields with where they come from: complete sets by document kind, sources, confirmation, and what a text is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.rates import let
from tidewright.functions.text import SPACE, anchor_count, count, search_text, strip
from tidewright.session import merged

#: The fields of each kind of document, and the sources that are documents.
FIELDS = {
    "payslip": (
        "grossSalary", "insuredSalary", "employeeContributionAmount", "employeeContributionRate", "employerContributionAmount", "employerContributionRate",
        "severanceContributionAmount", "severanceRate", "payslipMonth",
    ),
    "pensionReport": (
        "currentBalance", "balanceDate", "depositManagementFeeRate", "balanceManagementFeeRate", "pensionProvider", "reportDate", "latestReportedPensionableSalary",
        "latestEmployeeContributionAmount", "latestEmployerContributionAmount", "latestSeveranceContributionAmount", "latestEmployeeContributionRate",
        "latestEmployerContributionRate", "latestSeveranceRate",
    ),
}
DOCUMENT_SOURCES = ("payslip", "payslipDerived", "pensionReport", "pensionReportDerived", "crossValidated")
LEAST_SURE = 0.9
SIGNS = ("too-little-text", "unusable-character-order", "too-few-digits", "too-few-words", "no-payslip-anchors")


def envelope(value_num: Column, value_str: Column, source: Column, confidence: Column, unit: Column | None = None, confirm: Column | None = None, source_date: Column | None = None, method: Column | None = None) -> Column:
    """A value with its provenance; unless said, it has to be confirmed where its confidence is known and below LEAST_SURE."""
    none = F.lit(None).cast("string")
    default = F.coalesce(confidence < LEAST_SURE, F.lit(False))
    return F.struct(
        value_num.alias("value_num"), value_str.alias("value_str"), (none if unit is None else unit).alias("unit"), source.alias("source"), none.alias("source_document"), (none if source_date is None else source_date).alias("source_date"),
        confidence.alias("confidence"), (default if confirm is None else F.coalesce(confirm, default)).alias("requires_confirmation"), F.lit(False).alias("confirmed_by_user"), F.lit(None).cast("timestamp").alias("last_modified"),
        (none if method is None else method).alias("extraction_method"),
    )


def confirmed(item: Column, at: Column) -> Column:
    """An envelope after its user confirmed it."""
    return item.withField("requires_confirmation", F.lit(False)).withField("confirmed_by_user", F.lit(True)).withField("last_modified", at)


def set_by(item: Column, source: str, value_num: Column, by_user: bool) -> Column:
    """An envelope whose value was set anew: nothing of the earlier one remains."""
    fresh = envelope(value_num, F.lit(None).cast("string"), F.lit(source), F.lit(None).cast("double"))
    return fresh.withField("confirmed_by_user", F.lit(by_user)).cast("struct<value_num:double,value_str:string,unit:string,source:string,source_document:string,source_date:string,confidence:double,requires_confirmation:boolean,confirmed_by_user:boolean,last_modified:timestamp,extraction_method:string>")


def empty(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, name and an empty envelope for each field of the kind."""
    none = F.lit(None)
    names = F.explode(F.array(*map(F.lit, FIELDS[kind])))
    return docs.select("doc_id", names.alias("name"), envelope(none.cast("double"), none.cast("string"), F.lit(kind), none.cast("double")).alias("field"))


def wrap(docs: DataFrame, fields: DataFrame, kind: str) -> DataFrame:
    """doc_id, name, field: every field of the kind for every document, with what was extracted; other names and missing values don't count."""
    source = F.when(F.col("origin") == "derived", kind + "Derived").otherwise(kind)
    known = fields.filter(F.col("name").isin(*FIELDS[kind]) & (F.col("value_num").isNotNull() | F.col("value_str").isNotNull()))
    found = known.select("doc_id", "name", envelope(F.col("value_num"), F.col("value_str"), source, F.col("confidence"), F.col("unit"), F.col("confirm"), F.col("source_date"), F.col("method")).alias("found"))
    return empty(docs, kind).join(merged(found), ["doc_id", "name"], "left").select("doc_id", "name", F.coalesce("found", "field").alias("field"))


def identified_count(wrapped: DataFrame) -> DataFrame:
    """doc_id, identified, status: partial where any field was found, else manual-required."""
    found = F.count_if(F.col("field.value_num").isNotNull() | F.col("field.value_str").isNotNull())
    out = wrapped.groupBy("doc_id").agg(found.alias("identified"))
    return out.withColumn("status", F.when(F.col("identified") > 0, "partial").otherwise("manual-required"))


def counts(sources: Column) -> tuple[Column, Column]:
    """Of an array of sources (null: system), how many are documents and how many are the system."""
    known = F.transform(sources, lambda s: F.coalesce(s, F.lit("system")))
    return F.size(F.filter(known, lambda s: s.isin(*DOCUMENT_SOURCES))), F.size(F.filter(known, lambda s: s == "system"))


def assess_text(text: Column, kind: str) -> Column:
    """struct<useful, reason, score> of a document's own text: five signs, of which four are needed, among them length, digits and a label."""
    plain = strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x{0}-\\x{1f}]+", " "), f"{SPACE}+", " "))

    def signs(t: Column) -> Column:
        text = t["plain"]
        printable = F.try_divide(count(text, "[\\x{590}-\\x{5ff}\\x20-\\x7e]").cast("double"), F.length(text))
        found = {
            "too-little-text": F.length(text) >= 36,
            "unusable-character-order": F.coalesce(printable, F.lit(0.0)) >= 0.65,
            "too-few-digits": count(text, "[0-9]") >= 3,
            "too-few-words": count(text, "(?i)[\\x{590}-\\x{5ff}a-z]") >= 8,
            "no-payslip-anchors": anchor_count(t["searched"], kind) >= 1,
        }
        return F.struct(*[s.alias(name) for name, s in found.items()])

    def verdict(s: Column) -> Column:
        score = sum((s[name].cast("int") for name in SIGNS), F.lit(0))
        reason = F.coalesce(*[F.when(~s[name], F.lit(name)) for name in SIGNS], F.lit("native-text-usable"))
        useful = (score >= 4) & s["too-little-text"] & s["too-few-digits"] & s["no-payslip-anchors"]
        return F.struct(useful.alias("useful"), reason.alias("reason"), score.alias("score"))

    return let(let(F.struct(plain.alias("plain"), search_text(plain).alias("searched")), signs), verdict)
