"""Text as the document parsers see it: search form, numbers, dates, labels. Column expressions, but for Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.rates import clamp, let

# Patterns and label texts of the documents that are read. Order matters: the first label that a row holds names it.

SPACE = "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
NUMBER = "(?:₪" + SPACE + "*)?[-−]?[0-9OoIl|]+(?:[.,][0-9OoIl|]+)*(?:" + SPACE + "[0-9OoIl|]{3})*(?:" + SPACE + "*₪)?" + SPACE + "*%?"
AMOUNT = "[-−]?[0-9OoIl|]+(?:[.,][0-9OoIl|]+)*"
PERCENTAGE = "[0-9OoIl|]+(?:[.,][0-9OoIl|]+)?" + SPACE + "*%"
CURRENCY = "(?i)₪|ש[\"״']?ח|ILS"
DAY_DATE = "(?<![A-Za-z0-9_])([0-3]?[0-9])[/.\\-](0?[1-9]|1[0-2])[/.\\-](20[0-9]{2})(?![A-Za-z0-9_])"
MONTH_DATE = "(?<![A-Za-z0-9_])(0?[1-9]|1[0-2])[/.\\-](20[0-9]{2})(?![A-Za-z0-9_])"
ANY_DATE = "(?<![A-Za-z0-9_])(?:[0-3]?[0-9][/.\\-])?(?:0?[1-9]|1[0-2])[/.\\-]20[0-9]{2}(?![A-Za-z0-9_])"
YEARLY = "שנתי|שנתית|מצטבר|מתחילת השנה|annual|yearly|ytd"
MONTHLY = "חודשי|לחודש|monthly|current month"

PAYSLIP_LABELS = {
    "insuredSalary": [
        ("insured_salary", "שכר מבוטח"), ("pension_salary", "שכר לפנסיה"), ("determining_salary", "שכר קובע"), ("pensionable_salary_he", "שכר פנסיוני"),
        ("pension_base", "בסיס לפנסיה"), ("provident_base", "בסיס גמל"), ("pensionable_salary_en", "pensionable salary"), ("insured_salary_en", "insured salary"),
    ],
    "grossSalary": [("gross_salary_he", "שכר ברוטו"), ("gross_total_he", "סהכ ברוטו"), ("gross_salary_en", "gross salary"), ("gross_pay_en", "gross pay")],
    "employeeContribution": [
        ("employee_benefits", "תגמולי עובד"), ("employee_provident", "גמל עובד"), ("employee_pension", "עובד פנסיה"), ("employee_deposit", "הפרשת עובד"),
        ("employee_deduction", "ניכוי עובד לפנסיה"), ("employee_contribution_en", "employee contribution"),
    ],
    "employerContribution": [
        ("employer_benefits", "תגמולי מעסיק"), ("employer_provident", "גמל מעסיק"), ("employer_pension", "מעסיק פנסיה"), ("employer_deposit", "הפרשת מעסיק"),
        ("employer_contribution_en", "employer contribution"),
    ],
    "severanceContribution": [("severance", "פיצויים"), ("severance_deposit", "הפרשת פיצויים"), ("employer_severance", "פיצויי מעסיק"), ("severance_en", "severance")],
}
REPORT_LABELS = {
    "closingBalance": ["יתרת הכספים בקרן בסוף תקופת הדיווח", "יתרה בסוף תקופת הדיווח", "יתרה בסוף השנה", "יתרה נוכחית", "closing balance", "current balance"],
    "openingBalance": ["יתרה בתחילת תקופת הדיווח", "יתרת פתיחה", "opening balance", "beginning balance"],
    "personalFees": ["דמי ניהול אישיים", "דמי הניהול שנגבו ממך", "דמי ניהול שנגבו מהעמית", "personal management fees"],
    "fundAverage": ["ממוצע דמי ניהול בקרן", "דמי ניהול ממוצעים", "fund average", "average management fees"],
    "depositFee": ["דמי ניהול מהפקדה", "מהפקדה", "deposit fee"],
    "balanceFee": ["דמי ניהול מחיסכון", "דמי ניהול מצבירה", "מחיסכון", "מצבירה", "balance fee"],
    "provider": ["שם הגוף המוסדי", "שם הקרן", "שם קופת הגמל", "pension provider", "fund provider"],
}
# End of fixed values.


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Lower case in Unicode's compatibility composition, which no built-in function gives; ASCII and Hebrew letters are unchanged by it."""
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x.lower()) for x in text.to_pylist()], pa.string())


def _searchable(lowered: Column) -> Column:
    return F.trim(F.regexp_replace(lowered, "(?:[^\\x{590}-\\x{5ff}0-9a-z%.,/\\-]|[\\x{5f3}\\x{5f4}])+", " "))


def search_text(text: Column) -> Column:
    """Lower case, compatible characters as one, other than Hebrew, a-z, digits and % . , / - as single spaces."""
    return _searchable(nfkc(F.coalesce(text, F.lit(""))))


def label_search_text(text: str) -> str:
    """search_text() of a constant."""
    import re

    return re.sub("(?:[^֐-׿0-9a-z%.,/\\-]|[׳״])+", " ", unicodedata.normalize("NFKC", text.lower())).strip()


def first_label(searched: Column, field: str) -> Column:
    """The id of the field's first label that a search text holds; null if none."""
    return F.coalesce(*[F.when(F.contains(searched, F.lit(label_search_text(label))), F.lit(id_)) for id_, label in PAYSLIP_LABELS[field]])


def holds(searched: Column, field: str) -> Column:
    """Whether a search text holds any of a report's labels of the field."""
    out = F.lit(False)
    for label in REPORT_LABELS[field]:
        out = out | F.contains(searched, F.lit(label_search_text(label)))
    return out


def anchor_count(searched: Column, kind: str) -> Column:
    """How many groups of labels a search text holds: payslip's, or a report's closing balance and fees."""
    if kind == "payslip":
        found = [first_label(searched, field).isNotNull() for field in PAYSLIP_LABELS]
    else:
        found = [holds(searched, field) for field in ("closingBalance", "depositFee", "balanceFee")]
    return sum((f.cast("int") for f in found[1:]), found[0].cast("int"))


def strip(text: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


# ---------------------------------------------------------------- numbers


def ocr_digits(text: Column) -> Column:
    """O, o as 0 and I, l, | as 1 in a text with a digit and no fewer digits than such letters."""

    def repaired(t: Column) -> Column:
        digits, unsure = count(t, "[0-9]"), count(t, "[OoIl|]")
        return F.when((digits > 0) & (unsure <= digits), F.translate(t, "OoIl|", "00111")).otherwise(t)

    return let(strip(F.coalesce(text, F.lit(""))), repaired)


def sign(text: Column) -> tuple[Column, Column]:
    """Whether a number is negative (a leading minus, or brackets), and the text without its signs."""
    return text.rlike(f"^{SPACE}*[-−]") | text.rlike("\\([^)]+\\)"), F.regexp_replace(text, "[()−-]", "")


def plain_decimal(text: Column) -> Column:
    """Digits with at most one point: the last separator is one if one or two digits follow, and both kinds occur or its kind once; others group."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")

    def resolved(t: Column) -> Column:
        mark, tail, head = (F.regexp_extract(t, p, 1) for p in ("([.,])[^.,]*$", "[.,]([^.,]*)$", "^(.*)[.,][^.,]*$"))
        both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
        once = F.length(t) - F.length(F.replace(t, mark, F.lit(""))) == 1
        decimal = (mark != "") & F.length(tail).between(1, 2) & (both | once)
        return F.when(decimal, F.concat(digits(head), F.lit("."), digits(tail))).otherwise(digits(t))

    return let(F.regexp_replace(text, f"{SPACE}+", ""), resolved)


def financial(raw: Column, kind: str) -> Column:
    """struct<value, confidence, percent> of an amount or a rate as it is written; value is null and confidence 0 without a number.

    Rates with a percent sign or above 1 are hundredths. Unclear letters, many separators and implausible sizes lower the confidence.
    """

    def read(original: Column) -> Column:
        cleaned = F.regexp_replace(F.regexp_replace(ocr_digits(original), CURRENCY, ""), "%", "")
        cleaned = strip(F.regexp_replace(cleaned, f"(?!{SPACE})[^0-9.,()−-]", ""))
        return let(cleaned, lambda c: let(signed(c), lambda v: judged(original, v)))

    def signed(cleaned: Column) -> Column:
        negative, unsigned = sign(cleaned)
        size = plain_decimal(unsigned).try_cast("double")
        return F.when(negative, -size).otherwise(size)

    def judged(original: Column, size: Column) -> Column:
        percent = F.contains(original, F.lit("%"))
        value = F.when(percent | (F.abs(size) > 1), size / 100).otherwise(size) if kind == "rate" else size
        confidence = F.lit(0.96) - F.when(original.rlike("[OoIl|]"), 0.12).otherwise(0.0) - F.when(count(original, "[,.]") > 2, 0.08).otherwise(0.0)
        confidence = confidence - F.when(F.abs(value) > (1 if kind == "rate" else 1e8), 0.25).otherwise(0.0)
        return F.struct(value.alias("value"), F.when(value.isNull(), 0.0).otherwise(clamp(confidence, 0, 1)).alias("confidence"), percent.alias("percent"))

    return let(F.coalesce(raw, F.lit("")), read)


def fragments(text: Column, pattern: str = NUMBER) -> Column:
    """What looks like numbers in a text, in order, trimmed; each has a digit."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), strip)
    return F.filter(found, lambda x: x.rlike("[0-9]")) if pattern == NUMBER else found


# ---------------------------------------------------------------- dates and periods


def parse_date(text: Column) -> Column:
    """struct<display, key> of the first dd/mm/20yy, else mm/20yy, in a text; null if there is none."""
    two = lambda x: F.lpad(x, 2, "0")

    def found(t: Column) -> Column:
        day, month, year = (F.regexp_extract(t, DAY_DATE, i) for i in (1, 2, 3))
        m, y = F.regexp_extract(t, MONTH_DATE, 1), F.regexp_extract(t, MONTH_DATE, 2)
        whole = F.struct(F.concat_ws("/", two(day), two(month), year).alias("display"), (year.try_cast("int") * 372 + month.try_cast("int") * 31 + day.try_cast("int")).alias("key"))
        part = F.struct(F.concat_ws("/", two(m), y).alias("display"), (y.try_cast("int") * 372 + m.try_cast("int") * 31).alias("key"))
        return F.when(year != "", whole).when(y != "", part)

    return let(F.coalesce(text, F.lit("")), found)


def month_key(text: Column) -> Column:
    """Months since year 0 of the first mm/20yy in a text; 0 if there is none."""
    pattern = "(0?[1-9]|1[0-2])[/.\\-](20[0-9]{2})"
    text = F.coalesce(text, F.lit(""))
    year = F.regexp_extract(text, pattern, 2)
    return F.when(year != "", year.try_cast("int") * 12 + F.regexp_extract(text, pattern, 1).try_cast("int")).otherwise(F.lit(0))


def period_score(searched: Column) -> Column:
    """What a search text's words on periods add to a candidate: yearly ones -1.8, else monthly ones 0.45."""
    return F.when(searched.rlike(YEARLY), F.lit(-1.8)).when(searched.rlike(MONTHLY), F.lit(0.45)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- display


def money(amount: Column, compact: bool = True) -> Column:
    """An amount in shekels; compact ones in thousands or millions."""
    x = F.coalesce(amount, F.lit(0.0))
    size, minus = F.abs(x), F.when(x < 0, "-").otherwise("")
    whole = F.concat(minus, F.format_number(F.floor(size + 0.5), 0), F.lit(" ₪"))
    if not compact:
        return whole
    short = lambda value, digits: F.concat(minus, F.lit("₪"), F.format_string(f"%.{digits}f", value))
    millions = F.concat(F.when(size >= 1e7, short(size / 1e6, 1)).otherwise(short(size / 1e6, 2)), F.lit(" מיליון"))
    thousands = F.concat(F.when(size >= 1e5, short(size / 1e3, 0)).otherwise(short(size / 1e3, 1)), F.lit(" אלף"))
    return F.when(size >= 1e6, millions).when(size >= 1e3, thousands).otherwise(whole)


def percent(rate: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(rate, F.lit(0.0)) * 100)


def age(years: Column) -> Column:
    """Whole years, and months where there are any."""
    whole = F.floor(F.coalesce(years, F.lit(0.0)))
    months = F.floor((F.coalesce(years, F.lit(0.0)) - whole) * 12 + 0.5)
    return F.when(months > 0, F.concat(whole.cast("string"), F.lit(" ו־"), months.cast("string"), F.lit(" חודשים"))).otherwise(whole.cast("string"))
