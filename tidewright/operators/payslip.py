"""Fields of payslips: of all combinations of salary and contributions that numbers on the page allow, the most coherent one.

Tables are keyed by document throughout. A document has at most 10 salaries and 10 choices (and none) for each of three roles;
combinations are built role by role, and those that break a rule go before the next role is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.rates import let, near
from tidewright.functions.text import search_text
from tidewright.operators import layout
from tidewright.session import merged, settled

#: How many numbers around a label and how many choices count, what a choice adds to the score, and limits.
AMOUNTS, RATES, SALARY_AMOUNTS, CHOICES = 5, 4, 8, 10
ALONE_AMOUNT, ALONE_RATE, AGREED, CONFLICT, SAME_ROW, IMPLICIT_RATE, EACH_FIELD = 0.65, 0.45, 1.35, -2.75, 0.2, 0.92, 0.12
MOST_RATE, MOST_TOTAL, CLEAR_SALARY = 0.35, 0.65, 0.22
ROLES = {
    "employee": ("employeeContribution", "employeeContributionAmount", "employeeContributionRate"),
    "employer": ("employerContribution", "employerContributionAmount", "employerContributionRate"),
    "severance": ("severanceContribution", "severanceContributionAmount", "severanceRate"),
}


def _agrees(amount: Column, rate: Column, salary: Column) -> Column:
    return near(rate, F.try_divide(amount, salary), 0.00075, 0.02)


def _best_choices(options: DataFrame, key: list[str]) -> DataFrame:
    """Of options with one key the one with the highest score (the first of equal ones), then the CHOICES best, numbered from 1 by choice."""
    own = Window.partitionBy("doc_id", "field", *key)
    best = options.withColumns({"first": F.min("made").over(own), "place": F.row_number().over(own.orderBy(F.col("unary").desc(), "made"))}).filter("place = 1")
    order = Window.partitionBy("doc_id", "field").orderBy(F.col("unary").desc(), F.struct("first"))
    return best.withColumn("choice", F.row_number().over(order)).filter(F.col("choice") <= CHOICES).drop("place", "first")


_CANDIDATE = ["id", "value", "value_confidence", "explicit", "row_id", "period", "page"]


def _struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in _CANDIDATE])


def salary_options(values: DataFrame) -> DataFrame:
    """The best amounts for the insured salary: amount, alias_id, anchor_page, unary, choice."""
    rows = values.filter(f"field = 'insuredSalary' and kind = 'amount' and rank <= {SALARY_AMOUNTS} and value > 0")
    rows = rows.select("doc_id", "field", "alias_id", "anchor_page", "id", _struct().alias("amount"), (F.col("value_confidence") * 2 + F.col("period")).alias("unary"), F.struct("match", "rank").alias("made"))
    return _best_choices(rows, ["id"]).drop("id", "made", "field")


def contribution_options(values: DataFrame) -> DataFrame:
    """For each contribution the best amounts, rates and pairs of both around its labels: field, amount, rate, alias_id, anchor_page, unary, choice; and a row with neither (choice 11)."""
    of_field = values.filter(F.col("field").isin([r[0] for r in ROLES.values()]))
    keys = ["doc_id", "field", "match", "alias_id", "anchor_page"]
    amounts = of_field.filter(f"kind = 'amount' and rank <= {AMOUNTS}").select(*keys, _struct().alias("amount"), F.col("rank").alias("a"))
    rates = of_field.filter(f"kind = 'rate' and rank <= {RATES}").select(*keys, _struct().alias("rate"), F.col("rank").alias("r"))
    none_rate, none_amount = F.lit(None).cast(rates.schema["rate"].dataType), F.lit(None).cast(amounts.schema["amount"].dataType)
    rate_score = F.col("rate.value_confidence") * F.when(F.col("rate.explicit"), 1.0).otherwise(IMPLICIT_RATE) + F.col("rate.period")
    made = lambda step, a, r: F.struct("match", F.lit(step).alias("step"), F.lit(a).alias("a") if isinstance(a, int) else a, F.lit(r).alias("r") if isinstance(r, int) else r)
    alone_a = amounts.select(*keys, "amount", none_rate.alias("rate"), (F.col("amount.value_confidence") + F.col("amount.period")).alias("unary"), made(0, F.col("a"), 0).alias("made"))
    alone_r = rates.select(*keys, none_amount.alias("amount"), "rate", rate_score.alias("unary"), made(1, 0, F.col("r")).alias("made"))
    pairs = amounts.join(merged(rates), keys).filter("amount.id <> rate.id")
    both = F.col("amount.value_confidence") + F.col("rate.value_confidence") + F.col("amount.period") + F.col("rate.period") + F.when(F.col("amount.row_id") == F.col("rate.row_id"), SAME_ROW).otherwise(0.0)
    pairs = pairs.select(*keys, "amount", "rate", both.alias("unary"), made(2, F.col("a"), F.col("r")).alias("made"))
    options = alone_a.unionByName(alone_r).unionByName(pairs).withColumns({"amount_id": F.coalesce("amount.id", F.lit("-")), "rate_id": F.coalesce("rate.id", F.lit("-"))})
    return _best_choices(options, ["amount_id", "rate_id", "alias_id"]).drop("made", "match", "amount_id", "rate_id")


def _role_score(amount: Column, rate: Column, salary: Column, unary: Column) -> Column:
    both = amount.isNotNull() & rate.isNotNull()
    extra = F.when(both & _agrees(amount, rate, salary), AGREED).when(both, CONFLICT).when(amount.isNotNull(), ALONE_AMOUNT).otherwise(ALONE_RATE)
    return unary + extra


def evaluate_tuples(salaries: DataFrame, options: DataFrame) -> DataFrame:
    """All allowed combinations: salary, a choice for each role (null for none), score, direct_fields, places (the choices' numbers).

    No number is used twice; amounts are less than the salary and 35 % of it at most, as are rates; all together are less than 65 % of it.
    """
    out = salaries.select("doc_id", F.struct("amount", "alias_id", "anchor_page").alias("salary"), F.col("choice").alias("salary_choice"), F.col("unary").alias("score"), F.array("amount.id").alias("used"), F.lit(0.0).alias("total"), F.lit(1).alias("direct_fields"))
    base = F.col("salary.amount.value")
    for role, (field, _, _) in ROLES.items():
        chosen = F.struct("amount", "rate", "alias_id", "anchor_page", "unary")
        choices = options.filter(F.col("field") == field).select("doc_id", chosen.alias(role), F.col("choice").alias(f"{role}_choice"))
        none = salaries.select("doc_id").distinct().select("doc_id", F.lit(None).cast(choices.schema[role].dataType).alias(role), F.lit(CHOICES + 1).alias(f"{role}_choice"))
        out = out.join(merged(choices.unionByName(none)), "doc_id")
        amount, rate = F.col(f"{role}.amount.value"), F.col(f"{role}.rate.value")
        ids = F.array_compact(F.array(F.col(f"{role}.amount.id"), F.col(f"{role}.rate.id")))
        fine_amount = amount.isNull() | ((amount > 0) & (amount < base) & (amount / base <= MOST_RATE))
        fine_rate = rate.isNull() | ((rate > 0) & (rate <= MOST_RATE))
        out = out.filter(~F.arrays_overlap("used", ids) & fine_amount & fine_rate)
        out = out.withColumns(
            {
                "score": F.when(F.col(role).isNull(), F.col("score")).otherwise(F.col("score") + _role_score(amount, rate, base, F.col(f"{role}.unary"))),
                "used": F.concat("used", ids),
                "total": F.col("total") + F.coalesce(amount, F.lit(0.0)),
                "direct_fields": F.col("direct_fields") + F.size(ids),
            }
        )
    out = out.filter(F.col("total") < base * MOST_TOTAL)
    places = F.struct("salary_choice", *[f"{r}_choice" for r in ROLES])
    return out.select("doc_id", "salary", *ROLES, (F.col("score") + F.col("direct_fields") * EACH_FIELD).alias("score"), "direct_fields", places.alias("places"))


def global_tuple(solutions: DataFrame) -> DataFrame:
    """Each document's best combination, with solutions (their number) and ambiguous: whether one with another salary is nearly as good."""
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("direct_fields").desc(), "places")
    ranked = solutions.withColumns({"rank": F.row_number().over(order), "solutions": F.count("*").over(Window.partitionBy("doc_id"))})
    best = ranked.filter("rank = 1").drop("rank", "places")
    own = best.select("doc_id", F.col("salary.amount.id").alias("own"))
    others = ranked.join(merged(own), "doc_id").filter("salary.amount.id <> own").groupBy("doc_id").agg(F.min_by(F.struct("score", F.col("salary.amount.value").alias("value")), "rank").alias("other"))
    unclear = (F.col("score") - F.col("other.score") < CLEAR_SALARY) & ~near(F.col("salary.amount.value"), F.col("other.value"), 2, 0.025)
    return best.join(merged(others), "doc_id", "left").withColumn("ambiguous", F.coalesce(unclear, F.lit(False))).drop("other")


def candidate_counts(salaries: DataFrame, options: DataFrame, best: DataFrame) -> DataFrame:
    """doc_id, salaries, employee, employer, severance, solutions."""
    each = options.groupBy("doc_id").agg(*[F.count_if(F.col("field") == field).alias(role) for role, (field, _, _) in ROLES.items()])
    out = best.select("doc_id", "solutions").join(merged(salaries.groupBy("doc_id").agg(F.count("*").alias("salaries"))), "doc_id").join(merged(each), "doc_id", "left")
    return out.select("doc_id", "salaries", *[F.coalesce(r, F.lit(0)).alias(r) for r in ROLES], "solutions")


def rejected_conflicts(values: DataFrame, best: DataFrame) -> DataFrame:
    """doc_id, role: where a number that was chosen stands beside one that contradicts it at the chosen salary."""
    pairs = values.filter(f"kind = 'amount' and rank <= {AMOUNTS}").select("doc_id", "field", "match", F.col("id").alias("a"), F.col("value").alias("amount_value"))
    rates = values.filter(f"kind = 'rate' and rank <= {RATES}").select("doc_id", "field", "match", F.col("id").alias("r"), F.col("value").alias("rate_value"))
    pairs = pairs.join(merged(rates), ["doc_id", "field", "match"]).filter("a <> r")
    salary = F.col("salary.amount.value")
    chosen = best.select("doc_id", salary.alias("salary_value"), F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(f).alias("field"), F.col(r).alias("c")) for r, (f, _, _) in ROLES.items()])).alias("x"))
    chosen = chosen.select("doc_id", "salary_value", "x.role", "x.field", F.col("x.c.amount.id").alias("ca"), F.col("x.c.rate.id").alias("cr"), F.col("x.c.amount.value").alias("cav"), F.col("x.c.rate.value").alias("crv"))
    settled = F.col("ca").isNotNull() & F.col("cr").isNotNull() & _agrees(F.col("cav"), F.col("crv"), F.col("salary_value"))
    chosen = chosen.filter((F.col("ca").isNotNull() | F.col("cr").isNotNull()) & ~settled)
    touching = chosen.join(merged(pairs), ["doc_id", "field"]).filter(F.coalesce(F.col("a") == F.col("ca"), F.lit(False)) | F.coalesce(F.col("r") == F.col("cr"), F.lit(False)))
    return touching.filter(~_agrees(F.col("amount_value"), F.col("rate_value"), F.col("salary_value"))).select("doc_id", "role").distinct()


FIELD = "struct<value:double,unit:string,origin:string,confidence:double,confirm:boolean,alias_id:string,page:int,candidate_id:string,validation:string,alternatives:boolean,rejected:boolean>"


def direct(candidate: Column, alias_id: Column, page: Column, ocr: Column, unit: str, validation: Column, penalty: Column, confirm: Column) -> Column:
    """A field from a candidate; recognised text lowers its confidence and has to be confirmed."""
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), candidate["value_confidence"] * F.when(ocr, 0.94).otherwise(1.0)))
    field = F.struct(
        candidate["value"].alias("value"),
        F.lit(unit).alias("unit"),
        F.lit("direct").alias("origin"),
        F.greatest(F.lit(0.0), confidence - penalty).alias("confidence"),
        (ocr | confirm).alias("confirm"),
        alias_id.alias("alias_id"),
        page.alias("page"),
        candidate["id"].alias("candidate_id"),
        validation.alias("validation"),
        confirm.alias("alternatives"),
        F.lit(False).alias("rejected"),
    ).cast(FIELD)
    return F.when(candidate.isNotNull(), field)


def derived(value: Column, of: Column, ocr: Column, unit: str) -> Column:
    """A field computed from another one and the salary."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(of["confidence"] == 0, 0.75).otherwise(of["confidence"]) - 0.03))
    return F.struct(
        value.alias("value"), F.lit(unit).alias("unit"), F.lit("derived").alias("origin"), c.alias("confidence"), (ocr | of["confirm"]).alias("confirm"),
        of["alias_id"].alias("alias_id"), of["page"].alias("page"), of["candidate_id"].alias("candidate_id"), F.lit("derived-from-insured-salary").alias("validation"), of["alternatives"].alias("alternatives"), of["rejected"].alias("rejected"),
    ).cast(FIELD)


def cross_validate(amount: Column, rate: Column, salary: Column, ocr: Column) -> Column:
    """struct<amount, rate> after a check against the salary: a missing one is derived, two that agree gain confidence, two that don't lose it.

    In recognised text, a rate that contradicts an amount of about its confidence is replaced by the derived one.
    """
    base = salary["value"]
    usable = salary.isNotNull() & (base > 0)
    both = usable & amount.isNotNull() & rate.isNotNull()
    implied = F.try_divide(amount["value"], base)
    agree = near(rate["value"], implied, 0.00075, 0.02)
    verdict = F.when(agree, "amount-rate-agree").otherwise("amount-rate-conflict")

    def checked(x: Column) -> Column:
        c = F.when(agree, F.least(F.lit(0.99), x["confidence"] + 0.05)).otherwise(F.greatest(F.lit(0.0), x["confidence"] - 0.18))
        return x.withField("validation", verdict).withField("confidence", c).withField("confirm", x["confirm"] | ~agree).cast(FIELD)

    def settle(w: Column) -> Column:
        """The pair after the check: w has the amount and rate with their new confidence."""
        a, r = w["a"], w["r"]
        worse = F.greatest(F.lit(0.0), F.least(a["confidence"], r["confidence"]))
        replaced = r.withField("value", implied).withField("origin", F.lit("derived")).withField("unit", F.lit("ratio")).withField("confidence", worse).withField("confirm", F.lit(True)).withField("alternatives", F.lit(True)).cast(FIELD)
        return F.struct(a.alias("amount"), F.when(~agree & ocr & (a["confidence"] >= r["confidence"] - 0.12), replaced).otherwise(r).alias("rate"))

    pair = F.struct(amount.alias("amount"), rate.alias("rate"))
    from_rate = F.struct(derived(rate["value"] * base, rate, ocr, "ILS").alias("amount"), rate.alias("rate"))
    from_amount = F.struct(amount.alias("amount"), derived(implied, amount, ocr, "ratio").alias("rate"))
    compared = let(F.struct(checked(amount).alias("a"), checked(rate).alias("r")), settle)
    return F.when(both, compared).when(usable & amount.isNull() & rate.isNotNull(), from_rate).when(usable & rate.isNull() & amount.isNotNull(), from_amount).otherwise(pair)


# Dates and the words that say whether a date is the payslip's.
PERIOD = "(?:^|[^0-9])(0?[1-9]|1[0-2])[/.\\-](20[0-9]{2})(?![0-9])"
IS_PERIOD = "חודש שכר|חודש משכורת|תקופת שכר|לתקופה|חודש עבודה|payroll month|pay period|salary month|period"
NO_PERIOD = "תחילת עבודה|תאריך תחילת עבודה|ותק|תאריך לידה|birth(?:\\s+date)?|date of birth|printed|printing|generated|document date|הודפס|הפקה"
# End of fixed values.


def period_candidates(rows: DataFrame) -> DataFrame:
    """doc_id, value (mm/yyyy), page, score, positive, negative: the best of each month that a document names.

    A row's own words count in full, those of the rows around it less with their distance; of rows as far away, those above come first.
    """
    pairs = F.transform(F.regexp_extract_all("plain", F.lit(PERIOD), F.lit(0)), lambda m: F.concat(F.lpad(F.regexp_extract(m, PERIOD, 1), 2, "0"), F.lit("/"), F.regexp_extract(m, PERIOD, 2)))
    dated = rows.withColumn("plain", search_text(F.col("direct_text"))).select("doc_id", F.col("row").alias("anchor"), F.col("page").alias("anchor_page"), F.col("y").alias("anchor_y"), F.posexplode(pairs).alias("n", "value"))
    dated = dated.withColumn("field", F.concat_ws("|", F.lit("period"), F.col("n").cast("string")))
    around = layout.neighborhood(dated, rows, ties=("row",)).join(merged(rows.select("doc_id", "row", "search_text")), ["doc_id", "row"])
    own = F.col("row") == F.col("anchor")
    good, bad = F.col("search_text").rlike(IS_PERIOD), F.col("search_text").rlike(NO_PERIOD)
    far = lambda top: F.greatest(F.lit(0.12), top - F.col("away") / 180)
    adds = F.when(good, F.when(own, 3.1).otherwise(far(0.55))).otherwise(0.0) - F.when(bad, F.when(own, 2.8).otherwise(far(0.5))).otherwise(0.0)
    per = around.withColumns({"adds": adds, "good": own & good, "bad": own & bad}).groupBy("doc_id", "anchor", "n", "value", F.col("anchor_page").alias("page")).agg((F.sum("adds") + 0.2).alias("score"), F.max("good").alias("positive"), F.max("bad").alias("negative"))
    best = Window.partitionBy("doc_id", "value").orderBy(F.col("score").desc(), "anchor", "n")
    return per.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")


def payslip_period(rows: DataFrame, ocr: Column) -> DataFrame:
    """doc_id, value, page, confidence, clear, ambiguous: the month that fits best, and how far the second best is behind."""
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "anchor", "n")
    ranked = period_candidates(rows).withColumns({"rank": F.row_number().over(order), "second": F.lead("score").over(order), "candidates": F.count("*").over(Window.partitionBy("doc_id"))}).filter("rank = 1")
    margin = F.col("score") - F.col("second")
    clear = F.col("positive") & ~F.col("negative") & (F.col("second").isNull() | (margin >= 0.75))
    ambiguous = F.coalesce(margin < 0.75, F.lit(False))
    confidence = F.when(clear, F.when(ocr, 0.86).otherwise(0.97)).otherwise(0.58)
    return ranked.select("doc_id", "value", "page", F.when(ambiguous, F.least(confidence, F.lit(0.68))).otherwise(confidence).alias("confidence"), clear.alias("clear"), ambiguous.alias("ambiguous"), "candidates")


def _role(z: Column, ocr: Column) -> Column:
    """struct<amount, rate> of a role's choice z.c at the salary z.salary; z.hit: a number beside it contradicts it."""
    c, base = z["c"], z["salary"]["value"]
    paired = c["amount"].isNotNull() & c["rate"].isNotNull()
    agree = _agrees(c["amount"]["value"], c["rate"]["value"], base)
    verdict = F.when(paired & agree, "amount-rate-agree").when(paired, "amount-rate-conflict").otherwise("single-observation")
    clash = F.coalesce(paired & ~agree, F.lit(False))
    of = lambda kind, unit: direct(c[kind], c["alias_id"], c["anchor_page"], ocr, unit, verdict, F.when(clash, 0.18).otherwise(0.0), clash)

    def after(x: Column) -> Column:
        lowered = x.withField("confidence", F.greatest(F.lit(0.0), x["confidence"] - 0.08)).withField("confirm", F.lit(True)).withField("validation", F.lit("amount-rate-conflict")).withField("rejected", F.lit(True)).withField("alternatives", F.lit(True))
        return F.when(z["hit"] & x.isNotNull(), lowered.cast(FIELD)).otherwise(x)

    checked = let(F.struct(of("amount", "ILS").alias("amount"), of("rate", "ratio").alias("rate")), lambda p: cross_validate(p["amount"], p["rate"], z["salary"], ocr))
    return let(checked, lambda p: F.struct(after(p["amount"]).alias("amount"), after(p["rate"]).alias("rate")))


def parse(tokens: DataFrame, ocr: bool = False) -> DataFrame:
    """Fields of payslips: doc_id, name, value_num, value_str, unit, origin, confidence, confirm, alias_id, page, candidate_id, validation, alternatives, rejected, source_date, method.

    Documents without a salary that goes with any combination give only what doesn't depend on it.
    """
    rows = settled(layout.build_rows(tokens))
    values = settled(layout.label_values(rows))
    scan, no = F.lit(ocr), F.lit(False)
    salaries, options = settled(salary_options(values)), settled(contribution_options(values))
    best = settled(global_tuple(settled(evaluate_tuples(salaries, options))))
    gross = values.filter("field = 'grossSalary' and match = 1 and kind = 'amount' and rank = 1").select("doc_id", _struct().alias("gross"), F.col("alias_id").alias("gross_alias"), F.col("anchor_page").alias("gross_page"))
    conflicts = rejected_conflicts(values, best).groupBy("doc_id").agg(F.collect_set("role").alias("conflicts"))
    docs = rows.select("doc_id").distinct().join(merged(best), "doc_id", "left").join(merged(gross), "doc_id", "left").join(merged(conflicts), "doc_id", "left")
    unclear = F.coalesce("ambiguous", no)
    salary = direct(F.col("salary.amount"), F.col("salary.alias_id"), F.col("salary.anchor_page"), scan, "ILS", F.when(unclear, "ambiguous-salary-candidates").otherwise("not-checked"), F.when(unclear, 0.12).otherwise(0.0), unclear)
    docs = settled(docs.withColumns({"insuredSalary": salary, "grossSalary": direct(F.col("gross"), F.col("gross_alias"), F.col("gross_page"), scan, "ILS", F.lit("not-checked"), F.lit(0.0), no)}))
    names = ["insuredSalary", "grossSalary"]
    for role, (_, amount_name, rate_name) in ROLES.items():
        pair = let(F.struct(F.col(role).alias("c"), F.col("insuredSalary").alias("salary"), F.coalesce(F.array_contains("conflicts", role), no).alias("hit")), lambda z: _role(z, scan))
        docs = docs.withColumn(f"{role}_pair", pair)
        names += [amount_name, rate_name]
    docs = docs.withColumns({n: F.col(f"{role}_pair.{kind}") for role, (_, a, r) in ROLES.items() for kind, n in (("amount", a), ("rate", r))})
    docs = settled(docs.select("doc_id", *names))
    month = payslip_period(rows, scan).select("doc_id", F.col("value").alias("month"), F.col("page").alias("month_page"), F.col("confidence").alias("month_confidence"), "clear")
    docs = docs.join(merged(month), "doc_id", "left")
    rest = [F.struct(F.lit(n).alias("name"), F.col(n).alias("f")) for n in names]
    long = docs.select("doc_id", "month", F.explode(F.filter(F.array(*rest), lambda x: x["f"].isNotNull())).alias("x"))
    method = F.lit("ocr" if ocr else "pdf-text")
    fields = long.select("doc_id", "x.name", F.col("x.f.value").alias("value_num"), F.lit(None).cast("string").alias("value_str"), *[f"x.f.{c}" for c in ("unit", "origin", "confidence", "confirm", "alias_id", "page", "candidate_id", "validation", "alternatives", "rejected")], F.col("month").alias("source_date"), method.alias("method"))
    nothing = F.lit(None)
    months = month.select(
        "doc_id", F.lit("payslipMonth").alias("name"), nothing.cast("double").alias("value_num"), F.col("month").alias("value_str"), F.lit("month").alias("unit"), F.lit("direct").alias("origin"), F.col("month_confidence").alias("confidence"),
        (~F.col("clear")).alias("confirm"), F.lit("month-pattern").alias("alias_id"), F.col("month_page").alias("page"), nothing.cast("string").alias("candidate_id"),
        F.when(F.col("clear"), "semantic-period-context").otherwise("ambiguous-period-context").alias("validation"), no.alias("alternatives"), no.alias("rejected"), F.col("month").alias("source_date"), method.alias("method"),
    )
    return fields.unionByName(months)


def has_critical(fields: DataFrame) -> DataFrame:
    """doc_id of documents with a salary and any contribution."""
    contributions = [n for _, a, r in ROLES.values() for n in (a, r)]
    found = fields.groupBy("doc_id").agg(F.max((F.col("name") == "insuredSalary").cast("int")).alias("s"), F.max(F.col("name").isin(contributions).cast("int")).alias("c"))
    return found.filter("s = 1 and c = 1").select("doc_id")


def parse_with_fallback(tokens: DataFrame, texts: DataFrame, ocr: bool = False) -> DataFrame:
    """parse() of tokens; documents without critical fields whose plain text (doc_id, text) has them are read from the text, and marked in stream."""
    from tidewright.sources.tokens import of_document

    first = settled(parse(tokens, ocr))
    poor = texts.join(merged(has_critical(first)), "doc_id", "left_anti").join(merged(tokens.select("doc_id").distinct()), "doc_id", "left_semi").filter(F.trim("text") != "")
    poor = settled(poor.select("doc_id", "text"))
    if poor.isEmpty():
        return first.withColumn("stream", F.lit("tokens"))
    second = settled(parse(of_document(poor), ocr))
    better = has_critical(second)
    kept = first.join(merged(better), "doc_id", "left_anti").withColumn("stream", F.lit("tokens"))
    return kept.unionByName(second.join(merged(better), "doc_id", "left_semi").withColumn("stream", F.lit("flattened-text-fallback")))


def diagnostics(fields: DataFrame) -> DataFrame:
    """What may be logged of fields: no text and no value."""
    return fields.select("doc_id", "name", "method", "alias_id", "page", "confidence", "origin", "validation")
