"""Fields of pension reports: closing balance, management fees, provider, history of contributions, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.rates import let, near
from tidewright.functions.text import AMOUNT, ANY_DATE, MONTH_DATE, PERCENTAGE, REPORT_LABELS, SPACE, YEARLY, financial, fragments, holds, parse_date, search_text, strip
from tidewright.operators.layout import build_rows
from tidewright.session import merged, settled

#: Plausible balances, fees and contributions, and what makes a fee's place likely.
LEAST_BALANCE, MOST_BALANCE, MOST_FEE, LEAST_FEE_SCORE, FEE_ROWS = 100, 1e8, 0.2, 0.35, 5
FEES = {"depositManagementFeeRate": "depositFee", "balanceManagementFeeRate": "balanceFee"}
LEAST_SUM, MOST_RATE, MOST_TOTAL, RECENT = 20, 0.35, 0.65, 6
MEASURES = ("salary", "employee", "employer", "severance")


def _both(rows: DataFrame) -> Column:
    return F.concat_ws(" ", "direct_text", "reverse_text")


def nearby_rows(rows: DataFrame, radius: int) -> DataFrame:
    """rows with nearby: an array of the rows up to radius before and after, itself included, in order (row, direct_text, reverse_text, page)."""
    frame = Window.partitionBy("doc_id").orderBy("row").rowsBetween(-radius, radius)
    return rows.withColumn("nearby", F.collect_list(F.struct("row", "direct_text", "reverse_text", "page")).over(frame))


def balance_candidates(rows: DataFrame) -> DataFrame:
    """doc_id, value, score, page: amounts in or beside rows that name a closing balance."""
    named = holds(F.col("search_text"), "closingBalance") | (F.contains("search_text", F.lit("סוף")) & F.col("search_text").rlike("תקופת|דיווח|שנה"))
    near_by = nearby_rows(rows, 1).filter(named).select("doc_id", F.col("row").alias("anchor"), F.col("page").alias("page"), F.explode("nearby").alias("n"))
    raw = F.explode(fragments(F.concat_ws(" ", "n.direct_text", "n.reverse_text"), AMOUNT))
    out = near_by.select("doc_id", "anchor", "page", F.col("n.row").alias("row"), raw.alias("raw")).withColumn("value", financial(F.col("raw"), "amount")["value"])
    return out.filter(F.col("value").between(LEAST_BALANCE, MOST_BALANCE)).select("doc_id", "value", F.when(F.col("row") == F.col("anchor"), 1.0).otherwise(0.84).alias("score"), "page", "anchor")


def closing_balance(rows: DataFrame) -> DataFrame:
    """Each document's best balance: by score, then the larger value."""
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("value").desc(), "anchor")
    return balance_candidates(rows).withColumn("place", F.row_number().over(order)).filter("place = 1").select("doc_id", "value", "score", "page")


def fee_score(apart: Column, headed: Column, average: Column, personal: Column) -> Column:
    """How likely a percentage is a fee: near its label, under a header on personal fees (true) rather than averages (false; null: no header near)."""
    score = 1.1 - apart * 0.16 + F.when(apart == 0, 0.75).otherwise(0.0)
    score = score + F.when(headed, 0.45).when(~headed, -1.05).otherwise(0.0)
    return score + F.when(average, -1.4).otherwise(0.0) + F.when(personal, 0.35).otherwise(0.0)


def fee_candidates(rows: DataFrame) -> DataFrame:
    """doc_id, field, id, value, page, score, made: percentages with the nearest label of each fee, on their page and at most FEE_ROWS rows away.

    Labels are compared by page and distance, headers by rows; a document's rows are joined with its own labels only.
    """
    searched = F.col("search_text")
    tagged = rows.withColumns({"personal": holds(searched, "personalFees"), "average": holds(searched, "fundAverage"), "direct_search": search_text(F.col("direct_text"))})
    rates = tagged.select("doc_id", "row", "page", "y", "direct_search", F.posexplode(fragments(F.col("direct_text"), PERCENTAGE)).alias("n", "raw")).withColumn("value", financial(F.col("raw"), "rate")["value"])
    rates = rates.filter(f"value > 0 and value <= {MOST_FEE}")
    labels = tagged.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(holds(searched, group), F.struct(F.lit(field).alias("field"), F.col("row").alias("label_row"), F.col("page").alias("label_page"), F.col("y").alias("label_y"))) for field, group in FEES.items()]))).alias("label")).select("doc_id", "label.*")
    key = ["doc_id", "row", "n", "field"]
    distance = F.when(F.col("label_page") == F.col("page"), 0.0).otherwise(100.0) + F.abs(F.col("label_y") - F.col("y"))
    matched = rates.join(merged(labels), "doc_id").withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(distance, "label_row"))).filter("place = 1").drop("place")
    matched = matched.withColumn("apart", F.abs(F.col("label_row") - F.col("row"))).filter((F.col("label_page") == F.col("page")) & (F.col("apart") <= FEE_ROWS))
    headers = tagged.filter("personal or average").select("doc_id", F.col("row").alias("header_row"), F.col("personal").alias("header_personal"))
    by_header = Window.partitionBy(*key).orderBy(F.abs(F.col("header_row") - F.col("row")).asc_nulls_last(), "header_row")
    matched = matched.join(merged(headers), "doc_id", "left").withColumn("place", F.row_number().over(by_header)).filter("place = 1")
    headed = F.when(F.abs(F.col("header_row") - F.col("row")) <= FEE_ROWS, F.col("header_personal"))
    score = fee_score(F.col("apart"), headed, holds(F.col("direct_search"), "fundAverage"), holds(F.col("direct_search"), "personalFees"))
    return matched.select("doc_id", "field", F.format_string("p%d-r%d-fee%d", "page", "row", "n").alias("id"), "value", "page", score.alias("score"), F.struct("row", "n").alias("made"), F.col("apart"))


def fee_pair(candidates: DataFrame) -> DataFrame:
    """doc_id, field, value, page: the pair of a deposit and a balance fee (or one, or none) with the highest sum of scores that aren't the same number; each needs a score of its own."""
    order = Window.partitionBy("doc_id", "field").orderBy(F.col("score").desc(), "made")
    ranked = candidates.withColumn("place", F.row_number().over(order))
    sides = []
    for field, name in zip(FEES, ("d", "b"), strict=True):
        side = ranked.filter(F.col("field") == field).select("doc_id", F.struct("id", "value", "page", "score").alias(name), F.col("place").alias(f"{name}_place"))
        none = candidates.select("doc_id").distinct().select("doc_id", F.lit(None).cast(side.schema[name].dataType).alias(name), F.lit(1 << 30).alias(f"{name}_place"))
        sides.append(side.unionByName(none))
    pairs = sides[0].join(merged(sides[1]), "doc_id").filter(F.col("d").isNull() | F.col("b").isNull() | (F.col("d.id") != F.col("b.id")))
    total = F.coalesce("d.score", F.lit(0.0)) + F.coalesce("b.score", F.lit(0.0))
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(total.desc(), "d_place", "b_place"))).filter("place = 1")
    chosen = F.array(*[F.struct(F.lit(field).alias("field"), F.col(f"{name}.value").alias("value"), F.col(f"{name}.page").alias("page"), F.col(f"{name}.score").alias("score")) for field, name in zip(FEES, ("d", "b"), strict=True)])
    return best.select("doc_id", F.explode(chosen).alias("x")).select("doc_id", "x.*").filter(F.col("score") > LEAST_FEE_SCORE).select("doc_id", "field", "value", "page")


def provider(rows: DataFrame) -> DataFrame:
    """doc_id, value, page: the first name in, or in the row after, a row that names a provider; without labels, dashes and numbers."""

    def name(text: Column) -> Column:
        for label in REPORT_LABELS["provider"]:
            text = F.regexp_replace(text, "(?iu)" + label, " ")
        text = F.regexp_replace(text, "[-–—:|]+", " ")
        text = F.regexp_replace(text, "(?<![A-Za-z0-9_])[0-9][0-9.,/%-]*(?![A-Za-z0-9_])", " ")
        text = strip(F.regexp_replace(text, "\\s+", " "))
        return F.when((F.length(text) >= 3) & text.rlike("(?i)[\\x{590}-\\x{5ff}a-z]"), text)

    order = Window.partitionBy("doc_id").orderBy("row")
    out = rows.withColumn("next", F.lead("direct_text").over(order)).filter(holds(search_text(F.col("direct_text")), "provider"))
    out = out.withColumn("value", F.coalesce(name(F.col("direct_text")), name(F.coalesce("next", F.lit("")))))
    return out.filter("value is not null").withColumn("place", F.row_number().over(order)).filter("place = 1").select("doc_id", "value", "page")


def split_total(side: Column) -> Column:
    """The three contributions in the numbers beside a salary: of four or more, the one that is about the sum of the first three others is their total and goes; a total in front means reverse order."""
    without = lambda i: F.slice(F.filter(side, lambda _, k: k != i), 1, 3)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    at = F.get(F.filter(F.transform(side, lambda x, i: F.when((F.size(without(i)) == 3) & near(x, total(without(i)), 3, 0.012), i).otherwise(-1)), lambda i: i >= 0), 0)
    chosen = let(F.coalesce(at, F.lit(-1)), lambda i: F.when(i < 0, F.slice(side, 1, 3)).when(i == 0, F.reverse(without(i))).otherwise(without(i)))
    return F.when(F.size(side) >= 4, chosen).otherwise(F.slice(side, 1, 3))


def contribution_rows(rows: DataFrame) -> DataFrame:
    """doc_id, row, deposit_date, month, key, salary, employee, employer, severance, total, page: rows with a month, a salary and three plausible contributions; yearly rows don't count."""
    text = F.col("direct_text")
    dates = F.regexp_extract_all(text, F.lit(MONTH_DATE), F.lit(0))
    amounts = F.filter(F.transform(fragments(F.regexp_replace(text, ANY_DATE, " "), AMOUNT), lambda x: financial(x, "amount")["value"]), lambda v: v >= LEAST_SUM)
    rate = lambda v, salary: (v / salary > 0) & (v / salary <= MOST_RATE)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)

    def beside(sums: Column) -> Column:
        """The salary and the numbers less than it on the side that has them."""
        place = F.struct(F.array_max(sums).alias("salary"), F.array_position(sums, F.array_max(sums)).cast("int").alias("at"))

        def sides(p: Column) -> Column:
            less = lambda xs: F.filter(xs, lambda v: (v > 0) & (v < p["salary"]))
            both = F.struct(less(F.slice(sums, p["at"] + 1, F.size(sums))).alias("after"), less(F.slice(sums, F.lit(1), p["at"] - 1)).alias("before"))
            return let(both, lambda x: F.struct(p["salary"].alias("salary"), F.when(F.size(x["after"]) >= 3, x["after"]).otherwise(F.reverse(x["before"])).alias("side")))

        return let(place, sides)

    def found(row: Column) -> Column:
        """struct<salary, c, dates> of a plausible row; null otherwise."""
        chosen = let(beside(row["sums"]), lambda x: F.struct(x["salary"].alias("salary"), let(x["side"], split_total).alias("c"), row["dates"].alias("dates")))
        fine = lambda x: (F.size(x["c"]) >= 3) & F.forall(x["c"], lambda v: rate(v, x["salary"])) & (total(x["c"]) < x["salary"] * MOST_TOTAL)
        return F.when((F.size(row["dates"]) > 0) & (F.size(row["sums"]) >= 4), let(chosen, lambda x: F.when(fine(x), x)))

    raw = rows.filter(~search_text(text).rlike(YEARLY)).select("doc_id", "row", "page", let(F.struct(dates.alias("dates"), amounts.alias("sums")), found).alias("f"))
    out = settled(raw).filter("f is not null").select("doc_id", "row", "page", "f.*")
    month = parse_date(F.element_at("dates", -1))
    first = F.when(F.size("dates") > 1, parse_date(F.element_at("dates", 1))["display"])
    return out.select("doc_id", "row", first.alias("deposit_date"), month["display"].alias("month"), F.coalesce(month["key"], F.lit(0)).alias("key"), "salary", *[F.col("c")[i].alias(n) for i, n in enumerate(MEASURES[1:])], total(F.col("c")).alias("total"), "page")


def latest_row(history: DataFrame) -> DataFrame:
    """Each document's latest row; of equal months the first."""
    order = Window.partitionBy("doc_id").orderBy(F.col("key").desc(), "row")
    return history.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def recurring_evidence(history: DataFrame) -> DataFrame:
    """doc_id, recent, agreeing, recurring: of the RECENT latest rows, how many have about the latest one's sums (itself included); two make a pattern."""
    order = Window.partitionBy("doc_id").orderBy(F.col("key").desc(), "row")
    recent = history.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= RECENT)
    like = F.lit(True)
    for m in MEASURES:
        like = like & near(F.col(m), F.first(m).over(order), 2, 0.012)
    out = recent.withColumn("like", like).groupBy("doc_id").agg(F.count("*").alias("recent"), F.count_if("like").alias("agreeing"))
    return out.withColumn("recurring", F.col("agreeing") >= 2)


def latest_date(texts: DataFrame) -> DataFrame:
    """doc_id and display of the latest date anywhere in a text (doc_id, text)."""
    found = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(ANY_DATE), F.lit(0))).alias("n", "raw")).withColumn("d", parse_date(F.col("raw"))).filter("d is not null")
    return found.groupBy("doc_id").agg(F.max_by("d.display", F.struct(F.col("d.key"), -F.col("n"))).alias("display"))


_FIELD = ["doc_id", "name", "value_num", "value_str", "unit", "origin", "confidence", "alias_id", "page", "source_date", "recurring"]


def _field(df: DataFrame, name: Column | str, confidence: Column | float, unit: str, alias_id: Column | str, number: Column | None = None, text: Column | None = None, origin: str = "direct", page: Column | None = None, date: Column | None = None, recurring: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = [F.col("doc_id"), lit(name), (F.lit(None) if number is None else number).cast("double"), (F.lit(None) if text is None else text).cast("string"), F.lit(unit), F.lit(origin), lit(confidence).cast("double"), lit(alias_id), F.col("page") if page is None else page, (F.lit(None) if date is None else date).cast("string"), (F.lit(False) if recurring is None else recurring)]
    return df.select(*[v.alias(n) for v, n in zip(values, _FIELD, strict=True)])


def parse(tokens: DataFrame, texts: DataFrame | None = None, ocr: bool = False) -> DataFrame:
    """Fields of reports: doc_id, name, value_num, value_str, unit, origin, confidence, confirm, alias_id, page, source_date, recurring, method.

    texts (doc_id, text) is where the report's date is looked for; without it, the rows.
    """
    rows = settled(build_rows(tokens))
    balance = settled(closing_balance(rows))
    parts = [_field(balance, "currentBalance", F.when(F.col("score") >= 0.95, 0.97).otherwise(0.88), "ILS", "closing-balance", F.col("value"))]
    parts.append(_field(fee_pair(settled(fee_candidates(rows))), F.col("field"), 0.95, "ratio", F.col("field"), F.col("value")))
    parts.append(_field(provider(rows), "pensionProvider", 0.9, "text", "pension-provider", text=F.col("value")))
    history = settled(contribution_rows(rows))
    latest = settled(latest_row(history).join(merged(recurring_evidence(history)), "doc_id"))
    sure = F.when(F.col("recurring"), 0.97).otherwise(0.88)
    names = {"salary": "latestReportedPensionableSalary", "employee": "latestEmployeeContributionAmount", "employer": "latestEmployerContributionAmount", "severance": "latestSeveranceContributionAmount"}
    for measure, name in names.items():
        parts.append(_field(latest, name, sure, "ILS", "contribution-table", F.col(measure), date=F.col("month"), recurring=F.col("recurring")))
    for measure, name in (("employee", "latestEmployeeContributionRate"), ("employer", "latestEmployerContributionRate"), ("severance", "latestSeveranceRate")):
        parts.append(_field(latest, name, sure - 0.01, "ratio", "contribution-table", F.col(measure) / F.col("salary"), origin="derived", date=F.col("month"), recurring=F.col("recurring")))
    if texts is None:
        texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", _both(rows).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    dates = latest_date(texts)
    parts.append(_field(dates, "reportDate", 0.82, "date", "latest-date", text=F.col("display"), page=F.lit(1)))
    parts.append(_field(dates.join(merged(balance.select("doc_id")), "doc_id"), "balanceDate", 0.8, "date", "report-period-end", text=F.col("display"), origin="derived", page=F.lit(1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"confirm": F.col("confidence") < 0.9, "method": F.lit("ocr" if ocr else "pdf-text")})


def classification(text: Column) -> Column:
    return F.when(text.rlike("(?i)דוח\\s*שנתי|annual\\s*report".replace("\\s", SPACE)), "ANNUAL_PENSION_REPORT").otherwise("PERIODIC_PENSION_REPORT")


def with_token_fees(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """fields (of a report's text) in which fees that the tokens' places give replace the text's."""
    fees = settled(fee_pair(settled(fee_candidates(settled(build_rows(tokens))))))
    kept = fields.join(merged(fees.select("doc_id", F.col("field").alias("name"))), ["doc_id", "name"], "left_anti")
    new = _field(fees, F.col("field"), 0.96, "ratio", F.col("field"), F.col("value")).withColumns({"confirm": F.lit(False), "method": F.lit("pdf-text")})
    return kept.unionByName(new)
