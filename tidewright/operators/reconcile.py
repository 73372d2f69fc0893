"""Merges what a payslip and a pension report say: agreement first, then chronology, then the strength of the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.rates import finite, near
from tidewright.functions.text import month_key

#: From what confidence a period counts, by how much evidence has to be stronger, and tolerances (absolute, relative) by field.
RELIABLE, STRONGER = 0.8, 0.18
COMBINED = {
    "insuredSalary": ("latestReportedPensionableSalary", 2.0, 0.025),
    "employeeContributionAmount": ("latestEmployeeContributionAmount", 2.0, 0.025),
    "employeeContributionRate": ("latestEmployeeContributionRate", 0.0008, 0.025),
    "employerContributionAmount": ("latestEmployerContributionAmount", 2.0, 0.025),
    "employerContributionRate": ("latestEmployerContributionRate", 0.0008, 0.025),
    "severanceContributionAmount": ("latestSeveranceContributionAmount", 2.0, 0.025),
    "severanceRate": ("latestSeveranceRate", 0.001, 0.03),
}
REPORT_ONLY = ("currentBalance", "balanceDate", "reportDate", "pensionProvider", "depositManagementFeeRate", "balanceManagementFeeRate")
ITEM = "struct<value_num:double,value_str:string,origin:string,confidence:double,confirm:boolean,source_date:string,salary_month:string,date_confidence:double,recurring:boolean,method:string>"


def period_of(item: Column, fallback: Column) -> Column:
    """struct<value, key, confidence, reliable>: an item's month, or the fallback's."""
    blank = lambda x: F.when(x != "", x)
    number_text = F.when(fallback["value_num"].isNotNull(), fallback["value_num"].cast("string"))
    value = F.coalesce(blank(item["source_date"]), blank(item["salary_month"]), blank(fallback["source_date"]), blank(fallback["value_str"]), number_text)
    c = F.coalesce(item["date_confidence"], fallback["confidence"], F.when(blank(item["salary_month"]).isNotNull(), 0.95).otherwise(0.0))
    c = F.when(finite(c), c).otherwise(F.lit(0.0))
    key = month_key(value)
    return F.struct(value.alias("value"), key.alias("key"), c.alias("confidence"), ((key > 0) & (c >= RELIABLE)).alias("reliable"))


def evidence_strength(item: Column) -> Column:
    """An item's confidence, more for direct and recurring numbers, less for derived and recognised ones; 0 without an item."""
    s = F.coalesce(item["confidence"], F.lit(0.0))
    s = s + F.when(item["origin"] == "direct", 0.025).when(item["origin"] == "derived", -0.025).otherwise(0.0)
    s = s - F.when(item["method"] == "ocr", 0.04).otherwise(0.0) + F.when(item["recurring"], 0.035).otherwise(0.0)
    return F.when(item.isNull(), F.lit(0.0)).otherwise(s)


def combine(pairs: DataFrame) -> DataFrame:
    """pairs (first, second: ITEM; first_period, second_period: ITEM as fallbacks; absolute, relative) with the merged value.

    Adds value_num, value_str, origin, confidence, confirm, source_date, source (crossValidated or null), decision, conflict.
    """
    a, b = F.col("first"), F.col("second")
    out = pairs.withColumns({"p": period_of(a, F.col("first_period")), "q": period_of(b, F.col("second_period")), "sa": evidence_strength(a), "sb": evidence_strength(b)})
    p, q = F.col("p"), F.col("q")
    tolerance = F.when(F.coalesce(F.col("absolute"), F.lit(0.0)) == 0, 2.0).otherwise(F.col("absolute"))
    share = F.when(F.coalesce(F.col("relative"), F.lit(0.0)) == 0, 0.025).otherwise(F.col("relative"))
    unsure = (p["value"].isNotNull() & ~p["reliable"]) | (q["value"].isNotNull() & ~q["reliable"])
    decision = (
        F.when(a.isNull() & b.isNull(), None)
        .when(a.isNull(), "SECOND_ONLY")
        .when(b.isNull(), "FIRST_ONLY")
        .when(near(a["value_num"], b["value_num"], tolerance, share), "CROSS_DOCUMENT_VALIDATION")
        .when(p["reliable"] & q["reliable"] & (p["key"] != q["key"]), "CHRONOLOGY_RESOLVED")
        .when(unsure, "CROSS_DOCUMENT_CONFLICT")
        .when(F.abs(F.col("sa") - F.col("sb")) >= STRONGER, "STRONGER_INDEPENDENT_EVIDENCE")
        .otherwise("CROSS_DOCUMENT_CONFLICT")
    )
    out = out.withColumn("decision", decision)
    d = F.col("decision")
    second = (d == "SECOND_ONLY") | ((d == "CHRONOLOGY_RESOLVED") & (q["key"] > p["key"])) | ((d == "STRONGER_INDEPENDENT_EVIDENCE") & (F.col("sb") > F.col("sa")))
    won, date = F.when(second, b).otherwise(a), F.when(second, q["value"]).otherwise(p["value"])
    agreed, clash = d == "CROSS_DOCUMENT_VALIDATION", d == "CROSS_DOCUMENT_CONFLICT"
    most = F.greatest(F.coalesce(a["confidence"], F.lit(0.0)), F.coalesce(b["confidence"], F.lit(0.0)))
    capped = F.least(F.when(F.coalesce(a["confidence"], F.lit(0.0)) == 0, 0.8).otherwise(a["confidence"]), F.lit(0.78))
    newest = F.when(p["key"] >= q["key"], p["value"]).otherwise(q["value"])
    alone = d.isin("FIRST_ONLY", "SECOND_ONLY")
    source_date = F.when(agreed, F.coalesce(newest, a["source_date"], b["source_date"])).when(alone, won["source_date"]).when(d == "CHRONOLOGY_RESOLVED", date).otherwise(F.coalesce(date, won["source_date"]))
    return out.withColumns(
        {
            "value_num": won["value_num"],
            "value_str": won["value_str"],
            "origin": won["origin"],
            "confidence": F.when(agreed, F.least(F.lit(0.995), most + 0.08)).when(clash, capped).otherwise(won["confidence"]),
            "confirm": F.when(agreed, False).when(clash, True).otherwise(won["confirm"]),
            "source_date": source_date,
            "source": F.when(agreed, "crossValidated"),
            "conflict": F.when(clash, F.struct(a["value_num"].alias("first"), b["value_num"].alias("second"), p["value"].alias("first_period"), q["value"].alias("second_period"))),
        }
    ).drop("p", "q", "sa", "sb")


def items(fields: DataFrame) -> DataFrame:
    """case_id, name, item of a table of fields; columns that it lacks are null."""
    have = dict(fields.dtypes)
    part = lambda name, kind: (F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)).alias(name)
    kinds = [x.split(":") for x in ITEM.removeprefix("struct<").removesuffix(">").split(",")]
    rows = fields.filter(F.coalesce(part("value_num", "double").cast("string"), part("value_str", "string")).isNotNull())
    return rows.select("case_id", "name", F.struct(*[part(n, k) for n, k in kinds]).cast(ITEM).alias("item"))


def reconcile(payslip: DataFrame, report: DataFrame) -> DataFrame:
    """case_id, name and the merged value of both documents' fields (case_id, name, value_num, value_str, confidence, origin, ...).

    A full outer join by case and field: seven fields of a payslip have a counterpart in a report, six are the report's alone.
    """
    spark = payslip.sparkSession
    first, second = items(payslip), items(report)
    mapping = spark.createDataFrame([(n, m, a, r) for n, (m, a, r) in COMBINED.items()], "name string, other string, absolute double, relative double")
    mapping = F.broadcast(mapping)
    left = first.join(mapping.select("name"), "name").select("case_id", "name", F.col("item").alias("first"))
    right = second.withColumnRenamed("name", "other").join(mapping.select("name", "other"), "other").select("case_id", "name", F.col("item").alias("second"))
    pairs = left.join(right, ["case_id", "name"], "full").join(mapping.drop("other"), "name")
    month = first.filter("name = 'payslipMonth'").select("case_id", F.col("item").alias("first_period"))
    salary = second.filter("name = 'latestReportedPensionableSalary'").select("case_id", F.col("item").alias("second_period"))
    merged = combine(pairs.join(month, "case_id", "left").join(salary, "case_id", "left"))
    out = ["case_id", "name", "value_num", "value_str", "origin", "confidence", "confirm", "source_date", "source", "decision"]
    only = second.filter(F.col("name").isin(*REPORT_ONLY)).select("case_id", "name", *[F.col(f"item.{c}").alias(c) for c in out[2:8]], F.lit(None).cast("string").alias("source"), F.lit("SECOND_ONLY").alias("decision"))
    return merged.select(*out).unionByName(only)


def requires_confirmation(merged: DataFrame) -> DataFrame:
    """case_id and whether any of its fields has to be confirmed."""
    return merged.groupBy("case_id").agg(F.coalesce(F.bool_or("confirm"), F.lit(False)).alias("confirm"))
