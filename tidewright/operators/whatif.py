"""Variants of scenarios: sweeps over ages, returns and coefficients, and comparisons. A variant is a row; all are projected in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.rates import number, pension
from tidewright.operators.projection import PHASE, project

#: The annual real returns, conversion coefficients and shown rows of the standard comparisons.
RETURNS, COEFFICIENTS, SHOWN_COEFFICIENTS, SHOWN_AGES, COMPARED = (0.02, 0.04, 0.06), (180, 200, 220, 240), 5, 8, 4


def one_phase(rate: Column, kind: str, start: Column | None = None, end: Column | None = None) -> Column:
    start, end = F.col("current_age") if start is None else start, F.col("retirement_age") if end is None else end
    return F.array(F.struct(start.alias("start"), end.alias("end"), rate.alias("rate"), F.lit(kind).alias("kind"))).cast(f"array<{PHASE}>")


def extend_last_phase(phases: Column, age: Column) -> Column:
    """phases, of which the one with the greatest start (the later of equal ones) lasts to the age at least."""
    last = F.array_max(F.transform(phases, lambda p, i: F.struct(p["start"], i.alias("i"))))["i"]
    end = lambda p: F.greatest(age, F.when(number(p["end"]) == 0, age).otherwise(number(p["end"])))
    return F.transform(phases, lambda p, i: F.when(i == last, p.withField("end", end(p))).otherwise(p))


def age_sweep(scenarios: DataFrame, low: Column, high: Column) -> DataFrame:
    """A variant for each whole retirement age between the bounds that exceeds the current age."""
    first, last = F.ceil(low).cast("int"), F.floor(high).cast("int")
    ages = F.filter(F.when(first <= last, F.sequence(first, last)), lambda a: a > F.col("current_age"))
    variants = scenarios.withColumn("__swept", F.explode(ages))
    variants = variants.withColumn("retirement_age", F.col("__swept").cast("double")).drop("__swept")
    return variants.withColumns({name: extend_last_phase(F.col(name), F.col("retirement_age")) for name in ("salary_phases", "return_phases")})


def retirement_series(scenarios: DataFrame, low: Column, high: Column) -> DataFrame:
    """scenario_id, age, balances and pensions for each variant of age_sweep that has a projection."""
    variants = age_sweep(scenarios.withColumns({"__low": low, "__high": high}), F.col("__low"), F.col("__high"))
    out = project(variants, ["scenario_id", "retirement_age"]).filter("error is null")
    return out.select("scenario_id", F.col("retirement_age").alias("age"), "balance_real", "pension_real", "balance_nominal", "pension_nominal")


def explorer_bounds(age: Column, retirement: Column) -> tuple[Column, Column]:
    """The ages that are explored around a retirement age."""
    low = F.greatest(age + 1, F.greatest(F.lit(55.0), retirement - 4))
    return low, F.least(F.lit(80.0), F.greatest(retirement + 4, low + 4))


def explorer_pick(series: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Of each scenario's series the first, the last, the chosen and every other age, SHOWN_AGES at most."""
    own = Window.partitionBy("scenario_id").orderBy("age")
    rows = series.join(scenarios.select("scenario_id", F.col("retirement_age").alias("chosen")), "scenario_id")
    rows = rows.withColumns({"place": F.row_number().over(own) - 1, "rows": F.count("*").over(Window.partitionBy("scenario_id"))})
    rows = rows.filter("place = 0 or place = rows - 1 or age = chosen or place % 2 = 0")
    return rows.withColumn("shown", F.row_number().over(own)).filter(F.col("shown") <= SHOWN_AGES).drop("place", "rows", "chosen")


def return_sweep(scenarios: DataFrame, rates: tuple[float, ...] = RETURNS) -> DataFrame:
    """A variant for each real annual return, which replaces all phases of returns."""
    swept = scenarios.withColumn("swept", F.explode(F.array(*map(F.lit, rates))))
    return swept.withColumn("return_phases", one_phase(F.col("swept"), "real"))


def coefficient_sweep(projected: DataFrame, chosen: Column) -> DataFrame:
    """Pensions at the standard coefficients and the chosen one, the least SHOWN_COEFFICIENTS of them."""
    all_ = F.array_sort(F.array_distinct(F.array(*[F.lit(float(c)) for c in COEFFICIENTS], chosen.cast("double"))))
    rows = projected.withColumn("at", F.explode(F.slice(all_, 1, SHOWN_COEFFICIENTS)))
    return rows.select("scenario_id", F.col("at").alias("coefficient"), pension(F.col("balance_real"), F.col("at")).alias("pension_real"), pension(F.col("balance_nominal"), F.col("at")).alias("pension_nominal"))


def compare(a: DataFrame, b: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Of two projections with the same key, what b has more than a."""
    names = ("balance_real", "pension_real", "balance_nominal", "pension_nominal")
    return a.alias("a").join(b.alias("b"), key).select(key, *[(F.col(f"b.{n}") - F.col(f"a.{n}")).alias(f"{n}_delta") for n in names])


def without_breaks(scenarios: DataFrame) -> DataFrame:
    return scenarios.withColumn("breaks", F.slice("breaks", 1, 0))


def effect_of_breaks(scenarios: DataFrame) -> DataFrame:
    """scenario_id, break_months, and what the monthly real pension loses by the breaks."""
    both = scenarios.withColumn("variant", F.explode(F.array(F.lit("as is"), F.lit("no breaks"))))
    both = both.withColumn("breaks", F.when(F.col("variant") == "as is", F.col("breaks")).otherwise(F.slice("breaks", 1, 0)))
    months = F.aggregate(F.transform("breaks", lambda b: number(b["months"])), F.lit(0.0), lambda a, b: a + b)
    out = project(both.withColumn("break_months", months), ["scenario_id", "variant", "break_months"])
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("pension_real")))
    return out.groupBy("scenario_id").agg(F.max("break_months").alias("break_months"), (of("no breaks") - of("as is")).alias("pension_lost"))


def effect_of_last_year(scenarios: DataFrame) -> DataFrame:
    """scenario_id and what the last year before retirement adds to the real pension; 0 where the year before is no whole age."""
    before = F.greatest(F.col("current_age") + 1, F.col("retirement_age") - 1)
    earlier = retirement_series(scenarios, before, before).select("scenario_id", F.col("pension_real").alias("earlier"))
    now = project(scenarios).select("scenario_id", "pension_real")
    return now.join(earlier, "scenario_id", "left").select("scenario_id", F.coalesce(F.col("pension_real") - F.col("earlier"), F.lit(0.0)).alias("pension_gained"))


def scenario_table(saved: DataFrame) -> DataFrame:
    """measure and a column for each of the first COMPARED saved scenarios (by saved_order) that have a projection: a transposed comparison."""
    names = ["current_age", "retirement_age", "coefficient", "saved_order", "name"]
    out = project(saved, ["scenario_id", *names]).filter("error is null").orderBy("saved_order").limit(COMPARED)
    out = out.withColumn("column", F.concat(F.lit("scenario_"), F.row_number().over(Window.orderBy("saved_order"))))
    measures = ("current_age", "retirement_age", "balance_real", "pension_real", "coefficient")
    long = out.select("column", F.explode(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m))])).alias("measure", "value"))
    return long.groupBy("measure").pivot("column", [f"scenario_{i + 1}" for i in range(COMPARED)]).agg(F.first("value"))


def chart_domain(values: Column, margin: float = 1.08) -> Column:
    """The upper end of a chart's axis for an aggregated maximum."""
    return F.greatest(F.lit(1.0), F.max(values)) * margin


# ---------------------------------------------------------------- presets


def detect_preset() -> Column:
    """conservative, growth, base or null, of a scenario's phases of returns and coefficient."""
    phases, c = F.col("return_phases"), F.col("coefficient")
    at = lambda i, rate: (F.get(phases, i)["kind"] == "real") & (F.abs(F.get(phases, i)["rate"] - rate) <= 1e-9)
    single = F.size(phases) == 1
    return (
        F.when(single & at(0, 0.04) & (c == 230), "conservative")
        .when(single & at(0, 0.06) & (c == 190), "growth")
        .when(at(0, 0.055) & (c == 200) & (single | at(1, 0.045)), "base")
    )


def apply_preset(scenarios: DataFrame, name: Column) -> DataFrame:
    """scenarios with the phases of returns and the coefficient of a preset; names other than conservative and growth are base."""
    age, end, turn = F.col("current_age"), F.col("retirement_age"), F.col("current_age") + 15
    base = one_phase(F.lit(0.055), "real", age, F.least(end, turn))
    base = F.when(turn < end, F.concat(base, one_phase(F.lit(0.045), "real", turn, end))).otherwise(base)
    phases = F.when(name == "conservative", one_phase(F.lit(0.04), "real")).when(name == "growth", one_phase(F.lit(0.06), "real")).otherwise(base)
    c = F.when(name == "conservative", 230.0).when(name == "growth", 190.0).otherwise(200.0)
    return scenarios.withColumns({"return_phases": phases, "coefficient": c})


def career_path(name: Column) -> Column:
    """Phases of salary for the paths steady, inflation and aboveInflation; null for others."""
    rate = F.when(name == "steady", F.lit(0.0)).when(name == "inflation", F.col("inflation")).when(name == "aboveInflation", F.col("inflation") + 0.01)
    return F.when(rate.isNotNull(), one_phase(rate, "nominal"))


def investment_path(name: Column) -> Column:
    """Phases of returns for the paths low, base and high; null for others."""
    rate = F.when(name == "low", 0.02).when(name == "base", 0.04).when(name == "high", 0.06)
    return F.when(rate.isNotNull(), one_phase(rate, "real"))


def split_last_phase(phases: Column, current_age: Column) -> Column:
    """phases with the last one split at its middle; as they are if it spans less than two years."""
    last = F.try_element_at(phases, F.lit(-1))
    middle = F.greatest(current_age + 1, F.floor((last["start"] + last["end"]) / 2 + 0.5).cast("double"))
    halves = F.array(last.withField("end", middle), last.withField("start", middle))
    return F.when(last["end"] - last["start"] >= 2, F.concat(F.slice(phases, 1, F.size(phases) - 1), halves)).otherwise(phases)


def current_contribution() -> Column:
    """This month's contribution of a scenario."""
    limit = F.when(F.col("salary_limit") > 0, F.col("salary_limit")).otherwise(F.lit(float("inf")))
    rates = F.col("employee_rate") + F.col("employer_rate") + F.col("severance_rate")
    return F.when(F.col("mode") == "fixed", F.col("fixed_amount")).otherwise(F.least(F.col("pensionable_salary"), limit) * rates)


def for_projection(scenarios: DataFrame) -> DataFrame:
    """scenarios whose balance also has the additional savings, neither below 0."""
    floor = lambda name: F.greatest(F.lit(0.0), number(F.col(name)))
    return scenarios.withColumn("current_balance", floor("current_balance") + floor("additional_balance"))


def headline(amount: Column, step: float) -> Column:
    """An amount to the nearest step, halves up: 50 for pensions, 10,000 for balances."""
    return F.floor(amount / step + 0.5) * step

