"""Scenario state: defaults, ranges, phases and breaks in order, review and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.rates import clamp, finite, number, rounded, statutory_age
from tidewright.operators.projection import BREAK, PHASE
from tidewright.operators.whatif import one_phase

#: A scenario's defaults; ages are completed from the year of birth.
DEFAULTS = {
    "current_age": 35.0,
    "retirement_age": 67.0,
    "current_balance": 250000.0,
    "monthly_salary": 20000.0,
    "pensionable_salary": 20000.0,
    "additional_choice": "no",
    "additional_balance": 0.0,
    "confirmed": False,
    "inflation": 0.02,
    "mode": "percent",
    "fixed_amount": 4500.0,
    "fixed_grows": True,
    "employee_rate": 0.06,
    "employer_rate": 0.065,
    "severance_rate": 0.0833,
    "salary_limit": 0.0,
    "blend": False,
    "protected_weight": 0.30,
    "protected_real": 0.0515,
    "balance_fee": 0.005,
    "deposit_fee": 0.0,
    "coefficient": 200.0,
}
#: Ranges of numbers after normalisation; no upper end where None.
RANGES = {
    "current_balance": (0, None),
    "monthly_salary": (0, None),
    "pensionable_salary": (0, None),
    "additional_balance": (0, None),
    "fixed_amount": (0, None),
    "salary_limit": (0, None),
    "inflation": (0, 0.10),
    "employee_rate": (0, 0.30),
    "employer_rate": (0, 0.30),
    "severance_rate": (0, 0.30),
    "protected_weight": (0, 1),
    "protected_real": (0, 0.15),
    "balance_fee": (0, 0.05),
    "deposit_fee": (0, 0.10),
}
SAFE_ID = "^[a-zA-Z0-9_-]{1,64}$"


def safe_id(value: Column, *seed: Column) -> Column:
    """The id if it is 1 to 64 letters, digits, _ or -; else one that is derived from it and the seed, the same on every run."""
    own = F.coalesce(value, F.lit(""))
    return F.when(own.rlike(SAFE_ID), own).otherwise(F.md5(F.concat_ws("|", own, *[s.cast("string") for s in seed])))


def _or(x: Column, default: Column) -> Column:
    """x, or the default where it is no finite number or 0."""
    return F.when(number(x) == 0, default).otherwise(number(x))


def normalize_phases(phases: Column, age: Column, end: Column, kind: str) -> Column:
    """Phases in order that follow each other without gaps from the current age to retirement, each a year at least; one default phase where none is valid.

    kind is salary (types nominal unless real) or return (types real unless nominal). Each end depends on the one before, so this is a fold.
    """
    tagged = F.transform(F.filter(F.coalesce(phases, F.array().cast(f"array<{PHASE}>")), lambda p: finite(p["start"]) & finite(p["end"])), lambda p, i: F.struct(p["start"], p["end"], i.alias("i"), p["rate"], p["kind"]))
    most = F.greatest(F.lit(1), F.floor(end - age).cast("int"))
    items = F.slice(F.array_sort(tagged), F.lit(1), most)
    other = "real" if kind == "salary" else "nominal"
    usual = "nominal" if kind == "salary" else "real"

    def chain(done: Column, p: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], age)
        left = F.size(items) - F.size(done) - 1
        stop = F.when(left == 0, end).otherwise(clamp(p["end"], start + 1, end - left))
        rate = clamp(number(p["rate"]), -0.20, 0.20)
        own = F.when(p["kind"] == other, F.lit(other)).otherwise(F.lit(usual))
        return F.concat(done, F.array(F.struct(start.alias("start"), stop.alias("end"), rate.alias("rate"), own.alias("kind"))))

    empty = F.array().cast(f"array<{PHASE}>")
    default = one_phase(F.lit(0.0 if kind == "salary" else 0.04), usual, age, end)
    return F.when(F.size(items) == 0, default).otherwise(F.aggregate(items, empty, lambda a, p: chain(a, p).cast(f"array<{PHASE}>")))


def normalize_breaks(breaks: Column, age: Column, end: Column) -> Column:
    """Breaks in order that don't overlap, within the career, of 1 to 120 whole months; those with less than a month left go."""
    known = F.filter(F.coalesce(breaks, F.array().cast(f"array<{BREAK}>")), lambda b: finite(b["start"]))
    items = F.array_sort(F.transform(known, lambda b, i: F.struct(b["start"], i.alias("i"), b["id"], b["months"], b["contribution"], b["resume"], b["restart_salary"])))

    def place(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        start = F.greatest(age, b["start"], F.coalesce(last["start"] + last["months"] / 12, age))
        left = F.floor((end - start) * 12 + 1e-7)
        months = clamp(rounded(_or(b["months"], F.lit(1.0))), 1, F.least(F.lit(120.0), left.cast("double")))
        resume = F.when(b["resume"].isin("projected", "previous", "custom"), b["resume"]).otherwise("projected")
        floor = lambda x: F.greatest(F.lit(0.0), number(x))
        placed = F.struct(b["id"], start.alias("start"), months.alias("months"), floor(b["contribution"]).alias("contribution"), resume.alias("resume"), floor(b["restart_salary"]).alias("restart_salary"))
        return F.when(left < 1, done).otherwise(F.concat(done, F.array(placed).cast(f"array<{BREAK}>")))

    return F.aggregate(items, F.array().cast(f"array<{BREAK}>"), place)


def hydrate(raw: DataFrame, year: int) -> DataFrame:
    """Scenarios from partial ones: missing columns and nulls get defaults, ids of breaks become safe, then normalize()."""
    have = set(raw.columns)
    columns = {name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value) for name, value in DEFAULTS.items()}
    columns["birth_year"] = F.coalesce(F.col("birth_year"), F.lit(year - 35)) if "birth_year" in have else F.lit(year - 35)
    columns["track"] = F.col("track") if "track" in have else F.lit(None).cast("string")
    for name, kind in (("salary_phases", "salary"), ("return_phases", "return")):
        default = one_phase(F.lit(0.0 if kind == "salary" else 0.04), "nominal" if kind == "salary" else "real", F.lit(35.0), F.lit(67.0))
        columns[name] = F.when(F.size(name) > 0, F.col(name)).otherwise(default) if name in have else default
    empty = F.array().cast(f"array<{BREAK}>")
    columns["breaks"] = F.transform(F.coalesce("breaks", empty), lambda b, i: b.withField("id", safe_id(b["id"], i))) if "breaks" in have else empty
    return normalize(raw.withColumns(columns), year)


def normalize(scenarios: DataFrame, year: int) -> DataFrame:
    """Scenarios with every value in its range. `year` is the current year: results don't depend on a clock."""
    born = clamp(_or(F.col("birth_year").cast("double"), F.lit(year - 35.0)), year - 70, year - 18)
    columns: dict[str, Column] = {
        "birth_year": born.cast("int"),
        "track": F.when(F.col("track").isin("male", "female"), F.col("track")),
        "additional_choice": F.when(F.col("additional_choice").isin("no", "yes", "unsure"), F.col("additional_choice")).otherwise("no"),
        "confirmed": F.coalesce(F.col("confirmed"), F.lit(False)),
        "mode": F.when(F.col("mode") == "fixed", "fixed").otherwise("percent"),
        "fixed_grows": F.coalesce(F.col("fixed_grows"), F.lit(False)),
        "blend": F.coalesce(F.col("blend"), F.lit(False)),
        "coefficient": clamp(_or(F.col("coefficient"), F.lit(200.0)), 100, 400),
        "current_age": clamp(_or(F.col("current_age"), year - born), 18, 70),
    }
    for name, (low, high) in RANGES.items():
        columns[name] = F.greatest(F.lit(float(low)), number(F.col(name))) if high is None else clamp(number(F.col(name)), low, high)
    out = scenarios.withColumns(columns)
    age = F.col("current_age")
    out = out.withColumn("retirement_age", clamp(_or(F.col("retirement_age"), age + 1), age + 1, 80))
    end = F.col("retirement_age")
    return out.withColumns(
        {
            "salary_phases": normalize_phases(F.col("salary_phases"), age, end, "salary"),
            "return_phases": normalize_phases(F.col("return_phases"), age, end, "return"),
            "breaks": normalize_breaks(F.col("breaks"), age, end),
        }
    )


def sync_retirement(scenarios: DataFrame, year: int, force: bool = False) -> DataFrame:
    """scenarios with the age of their year of birth, and the statutory retirement age unless retirement_source is user."""
    born = clamp(F.col("birth_year").cast("double"), year - 70, year - 18)
    free = F.lit(force) | ~F.coalesce(F.col("retirement_source") == "user", F.lit(False))
    return scenarios.withColumns(
        {
            "birth_year": born.cast("int"),
            "current_age": year - born,
            "retirement_age": F.when(free, statutory_age(born, F.col("track"))).otherwise(F.col("retirement_age")),
            "retirement_source": F.when(free, "system").otherwise(F.col("retirement_source")),
        }
    )


def review_errors(year: int) -> Column:
    """What a review still lacks, in order: birth_year, track, pensionable_salary, current_balance, confirmed."""
    lacks = lambda ok, name: F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name))
    return F.array_compact(
        F.array(
            lacks(F.col("birth_year").between(year - 70, year - 18), "birth_year"),
            lacks(F.col("track").isNotNull(), "track"),
            lacks(F.col("pensionable_salary") > 0, "pensionable_salary"),
            lacks(F.col("current_balance") >= 0, "current_balance"),
            lacks(F.col("confirmed"), "confirmed"),
        )
    )


#: Extracted fields and the scenario's columns that take them.
EXTRACTED = {
    "insuredSalary": "pensionable_salary",
    "grossSalary": "monthly_salary",
    "employeeContributionRate": "employee_rate",
    "employerContributionRate": "employer_rate",
    "severanceRate": "severance_rate",
    "currentBalance": "current_balance",
    "depositManagementFeeRate": "deposit_fee",
    "balanceManagementFeeRate": "balance_fee",
}


def apply_extraction(scenarios: DataFrame, fields: DataFrame) -> DataFrame:
    """scenarios with the values of fields (scenario_id, name, value_num) where there are any."""
    wide = fields.groupBy("scenario_id").pivot("name", list(EXTRACTED)).agg(F.max("value_num"))
    joined = scenarios.join(wide, "scenario_id", "left")
    return joined.withColumns({column: F.coalesce(F.col(name), F.col(column)) for name, column in EXTRACTED.items()}).drop(*EXTRACTED)
