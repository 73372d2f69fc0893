"""The month-by-month projection of a scenario's savings.

A scenario is one row with the columns of SCENARIO. Constants, ordered phases and their monthly rates are column expressions; the months
then run in Arrow batches, each month as vectors over all scenarios of a batch, without a shuffle. (As a higher-order function
over a row's months the same fold takes some fifty times as long.) Any number of variants of a scenario are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.rates import annual_to_monthly, clamp, finite, nominal_rate, number, pension, real_to_nominal, rounded
from tidewright.session import ready

PHASE = "struct<start:double,end:double,rate:double,kind:string>"
BREAK = "struct<id:string,start:double,months:double,contribution:double,resume:string,restart_salary:double>"
SCENARIO = f"""scenario_id long, current_age double, retirement_age double, current_balance double, monthly_salary double, pensionable_salary double,
 inflation double, mode string, fixed_amount double, fixed_grows boolean, employee_rate double, employer_rate double, severance_rate double, salary_limit double,
 blend boolean, protected_weight double, protected_real double, balance_fee double, deposit_fee double, coefficient double,
 salary_phases array<{PHASE}>, return_phases array<{PHASE}>, breaks array<{BREAK}>"""

SNAPSHOT = [
    *("month", "age", "nominal_balance", "real_balance", "nominal_salary", "real_salary", "contributions_nominal", "contributions_real"),
    *("net_contributions_nominal", "net_contributions_real", "fees_nominal", "fees_real", "gain_nominal"),
]
_TOTALS = ["contributions", "net_contributions", "fees", "deposit_fees", "balance_fees"]


def ordered(phases: Column) -> Column:
    """Phases with finite bounds by start, then end, then place."""
    tagged = F.transform(F.filter(F.coalesce(phases, F.array().cast(f"array<{PHASE}>")), lambda p: finite(p["start"]) & finite(p["end"])), lambda p, i: F.struct(p["start"], p["end"], i.alias("i"), p["rate"], p["kind"]))
    return F.array_sort(tagged)


def phase_at(phases: Column, age: Column) -> Column:
    """As of an age: of ordered phases, the last that covers it, else the last that began before it, else the first; null without phases."""
    begun = F.filter(phases, lambda p: p["start"] <= age)
    covering = F.filter(begun, lambda p: age < p["end"])
    return F.coalesce(F.try_element_at(covering, F.lit(-1)), F.try_element_at(begun, F.lit(-1)), F.try_element_at(phases, F.lit(1)))


def break_at(breaks: Column, age: Column) -> Column:
    """Of breaks by start, the last whose months hold the age; null if none does."""
    return F.try_element_at(F.filter(breaks, lambda b: (b["start"] <= age) & (age < b["start"] + b["months"] / 12)), F.lit(-1))


def _breaks() -> Column:
    known = F.filter(F.coalesce(F.col("breaks"), F.array().cast(f"array<{BREAK}>")), lambda b: finite(b["start"]) & (number(b["months"]) > 0))
    key = lambda b: F.coalesce(F.when(b["id"] != "", b["id"]), F.concat_ws("|", b["start"].cast("string"), b["months"].cast("string")))
    return F.array_sort(F.transform(known, lambda b, i: F.struct(b["start"], i.alias("i"), key(b).alias("id"), b["months"], number(b["contribution"]).alias("contribution"), b["resume"], number(b["restart_salary"]).alias("restart_salary"))))


def _by_month(phases: Column, default: str) -> Column:
    """Ordered phases with their monthly nominal rate."""
    kind = lambda p: F.coalesce(F.when(p["kind"] != "", p["kind"]), F.lit(default))
    return F.transform(ordered(phases), lambda p: F.struct(p["start"], p["end"], annual_to_monthly(nominal_rate(p["rate"], kind(p), F.col("inflation"))).alias("monthly")))


def _prepared(scenarios: DataFrame) -> DataFrame:
    """scenarios with the constants of their fold, under __ names, and __error where there is no projection."""
    age, end = F.col("current_age"), F.col("retirement_age")
    base = F.greatest(F.lit(0.0), number(F.col("monthly_salary")))
    insured = F.greatest(F.lit(0.0), number(F.coalesce(F.col("pensionable_salary"), base)))
    fees = clamp(number(F.col("balance_fee")), 0, 0.25)
    error = F.when(~(finite(age) & finite(end) & (end > age)), "retirement age has to exceed current age").when(F.col("inflation") <= -1, "an annual rate has to exceed -100 %")
    market = _by_month(F.col("return_phases"), "real")
    weight, safe = clamp(number(F.col("protected_weight")), 0, 1), annual_to_monthly(real_to_nominal(F.col("protected_real"), F.col("inflation")))
    return (
        scenarios.withColumns(
            {
                "__months": F.when(error.isNull(), F.greatest(F.lit(1), rounded((end - age) * 12).cast("int"))),
                "__mi": annual_to_monthly(F.col("inflation")),
                "__base": base,
                "__insured": insured,
                "__asset_fee": 1 - F.pow(1 - fees, F.lit(1 / 12)),
                "__deposit_fee": clamp(number(F.col("deposit_fee")), 0, 0.25),
                "__start_balance": F.greatest(F.lit(0.0), number(F.col("current_balance"))),
                "__rate": number(F.col("employee_rate")) + number(F.col("employer_rate")) + number(F.col("severance_rate")),
                "__limit": F.when(F.col("salary_limit") > 0, F.col("salary_limit")).otherwise(F.lit(float("inf"))),
                "__fixed": F.greatest(F.lit(0.0), number(F.col("fixed_amount"))),
                "__salary_phases": _by_month(F.col("salary_phases"), "nominal"),
                "__return_phases": market,
                "__weight": F.when(F.col("blend"), weight),
                "__safe": safe,
                "__breaks": _breaks(),
                "__error": error,
            }
        )
        .withColumn("__ratio", F.when(F.col("__base") > 0, F.col("__insured") / F.col("__base")).otherwise(F.lit(1.0)))
    )


def break_calendar(scenarios: DataFrame) -> DataFrame:
    """scenario_id, month, break_id, goes_on for each month that is in a break: whether the next month is in one too. Where it isn't, the salary resumes."""
    known = _prepared(scenarios).filter("__error is null").select("scenario_id", "current_age", "__breaks", F.explode(F.sequence(F.lit(0), F.col("__months") - 1)).alias("month"))
    age = lambda later: F.col("current_age") + (F.col("month") + later) / 12
    found = known.withColumns({"now": break_at(F.col("__breaks"), age(0)), "then": break_at(F.col("__breaks"), age(1))})
    return found.filter("now is not null").select("scenario_id", "month", F.col("now.id").alias("break_id"), F.col("then").isNotNull().alias("goes_on"))


_INPUTS = [
    *("__months", "current_age", "__mi", "__base", "__start_balance", "__ratio", "__limit", "__rate", "__fixed", "__asset_fee", "__deposit_fee", "__weight", "__safe"),
    *("__percent", "__grows", "__salary_phases", "__return_phases", "__breaks", "__error"),
]
_RESULTS = ["inflation_index", "balance", "salary", *[f"{t}_{m}" for t in _TOTALS for m in ("nominal", "real")], "gain"]
_LOST = "an annual rate has to exceed -100 %"


def _padded(column: pa.Array, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a column of arrays of structs: each row's length, and a matrix (place, row) for each field; numbers are NaN beyond the end."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = {}
    for name in names:
        values = flat.field(flat.type.get_field_index(name)).to_numpy(zero_copy_only=False)
        table = np.full((int(lengths.max(initial=0)), len(column)), np.nan if values.dtype.kind == "f" else None, dtype=float if values.dtype.kind == "f" else object)
        table[place, row] = values
        out[name] = table
    return lengths, out


def _as_of(phases: dict[str, np.ndarray], age: np.ndarray, empty: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """phase_at() for a vector of ages: monthly rates, `empty` for rows without phases."""
    out = np.where(lengths > 0, phases["monthly"][0], empty) if len(phases["monthly"]) else empty.copy()
    covered = np.full(len(age), np.nan)
    inside = np.zeros(len(age), bool)
    for start, end, monthly in zip(phases["start"], phases["end"], phases["monthly"], strict=True):
        begun = start <= age
        out = np.where(begun, monthly, out)
        cover = begun & (age < end)
        covered, inside = np.where(cover, monthly, covered), inside | cover
    return np.where(inside, covered, out)


def _paused(breaks: dict[str, np.ndarray], age: np.ndarray) -> np.ndarray:
    """break_at() for a vector of ages: the place of the break, -1 without one."""
    out = np.full(len(age), -1)
    for k, (start, months) in enumerate(zip(breaks["start"], breaks["months"], strict=True)):
        out = np.where((start <= age) & (age < start + months / 12), k, out)
    return out


def _fold(kept: int):
    """Months one after the other, each for all scenarios of a batch at once; in the order of operations of one scenario's month.

    A month: break, index, contribution and its fee, return, fee on the balance, salary growth, end of a break, snapshot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield month_by_month(batch)

    def month_by_month(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = dict(zip(_INPUTS, batch.columns[kept:], strict=True))
        n = batch.num_rows
        number = {c: pc.fill_null(column[c].cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in _INPUTS[:13]}
        flag = {c: pc.fill_null(column[c], False).to_numpy(zero_copy_only=False).astype(bool) for c in ("__percent", "__grows")}
        errors = column["__error"].to_pylist()
        months = np.where([e is None for e in errors], np.nan_to_num(number["__months"]), 0).astype(np.int64)
        wages, wage = _padded(column["__salary_phases"], ["start", "end", "monthly"])
        funds, fund = _padded(column["__return_phases"], ["start", "end", "monthly"])
        _, stop = _padded(column["__breaks"], ["start", "months", "contribution", "restart_salary", "id", "resume"])
        ids = {x: i for i, x in enumerate(dict.fromkeys(stop["id"].ravel().tolist()))}
        code = np.array([[ids[x] for x in r] for r in stop["id"].tolist()], np.int64).reshape(stop["id"].shape)
        rows = np.arange(n)
        start, base, mi = number["current_age"], number["__base"], number["__mi"]
        salary, balance, index = base.copy(), number["__start_balance"].copy(), np.ones(n)
        total = {name: np.zeros(n) for name in _RESULTS[3:]}
        pause_id, held, lost = np.full(n, -1), np.full(n, np.nan), np.zeros(n, bool)
        taken: list[tuple[np.ndarray, np.ndarray]] = []

        def snapshot(month: int, due: np.ndarray) -> None:
            age = start + month / 12
            values = [np.full(n, float(month)), age, balance, balance / index, salary, salary / index, *[total[f"{t}_{m}"] for t in ("contributions", "net_contributions", "fees") for m in ("nominal", "real")], total["gain"]]
            at = rows[due]
            taken.append((at, np.stack([v[at] for v in values])))

        with np.errstate(all="ignore"):
            snapshot(0, months > 0)
            for m in range(int(months.max(initial=0))):
                live = months > m
                age = start + m / 12
                place = _paused(stop, age)
                off = place >= 0
                own = (np.maximum(place, 0), rows)
                goes_on = _paused(stop, start + (m + 1) / 12) >= 0
                field = (lambda name: stop[name][own]) if len(code) else (lambda name: np.zeros(n))  # noqa: B023
                which = code[own] if len(code) else np.zeros(n, np.int64)
                fresh = off & (pause_id != which)
                held, pause_id = np.where(fresh, salary, held), np.where(fresh, which, pause_id)
                new_index = index * (1 + mi)
                growth = _as_of(wage, age, np.zeros(n), wages)
                earned = _as_of(fund, age, mi, funds)
                earned = np.where(np.isnan(number["__weight"]), earned, number["__weight"] * number["__safe"] + (1 - number["__weight"]) * earned)
                lost |= live & (np.isnan(growth) | np.isnan(earned))
                by_rate = np.maximum(0, np.minimum(salary * number["__ratio"], number["__limit"]) * number["__rate"])
                by_sum = number["__fixed"] * np.where(flag["__grows"] & (base > 0), salary / base, 1.0)
                gross = np.where(off, np.maximum(0, field("contribution").astype(float)), np.where(flag["__percent"], by_rate, by_sum))
                fee = gross * number["__deposit_fee"]
                net = gross - fee
                paid = balance + net
                gain = paid * earned
                full = paid + gain
                charge = full * number["__asset_fee"]
                new_salary = salary * (1 + growth)
                over = off & ~goes_on
                if over.any():
                    resume = field("resume")
                    back = np.where((resume == "previous") & ~np.isnan(held), held, np.where(resume == "custom", np.maximum(0, field("restart_salary").astype(float)), new_salary))
                    new_salary = np.where(over, back, new_salary)
                    held, pause_id = np.where(over, np.nan, held), np.where(over, -1, pause_id)
                added = {"contributions": gross, "net_contributions": net, "deposit_fees": fee, "balance_fees": charge}
                for name, x in added.items():
                    total[f"{name}_nominal"] = np.where(live, total[f"{name}_nominal"] + x, total[f"{name}_nominal"])
                    total[f"{name}_real"] = np.where(live, total[f"{name}_real"] + x / new_index, total[f"{name}_real"])
                total["fees_nominal"] = np.where(live, total["fees_nominal"] + fee + charge, total["fees_nominal"])
                total["fees_real"] = np.where(live, total["fees_real"] + fee / new_index + charge / new_index, total["fees_real"])
                total["gain"] = np.where(live, total["gain"] + gain, total["gain"])
                salary, balance, index = np.where(live, new_salary, salary), np.where(live, full - charge, balance), np.where(live, new_index, index)
                due = live & (((m + 1) % 12 == 0) | (m + 1 == months))
                if due.any():
                    snapshot(m + 1, due)
        errors = [e or (_LOST if bad else None) for e, bad in zip(errors, lost.tolist(), strict=True)]
        void = np.array([e is not None for e in errors], bool)
        results = [index, balance, salary, *[total[name] for name in _RESULTS[3:]]]
        at = np.concatenate([t[0] for t in taken])
        order = np.argsort(at, kind="stable")
        values = np.concatenate([t[1] for t in taken], axis=1)[:, order]
        counts = np.bincount(at, minlength=n)
        fields = [pa.array(values[0].astype(np.int32)), *[pa.array(v) for v in values[1:]]]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.StructArray.from_arrays(fields, SNAPSHOT))
        lists = pc.if_else(pa.array(~void), lists, pa.scalar(None, lists.type))
        arrays = [*batch.columns[:kept], pa.array(errors, pa.string()), pa.array(months, pa.int32(), mask=void), *[pa.array(r, pa.float64(), mask=void) for r in results], lists]
        return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:kept], "error", "months", *_RESULTS, "snapshots"])

    return run


def project(scenarios: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """scenario_id (and the columns of keep), error, and the projection: months, balances, pensions, totals, growth, final salaries, snapshots.

    A scenario whose ages or rates don't allow a projection has its error and nulls; scenarios with other rates or ages are
    unaffected. Phases with no finite bounds are left out; of overlapping phases or breaks the later one holds.
    """
    keep = ["scenario_id"] if keep is None else keep
    ready(scenarios.sparkSession)
    prepared = _prepared(scenarios).withColumns({"__percent": F.col("mode") == "percent", "__grows": F.col("fixed_grows")})
    names = list(dict.fromkeys([*keep, "coefficient", "__start_balance"]))
    slim = prepared.select(*names, *[F.col(c).alias(f"in_{i}") for i, c in enumerate(_INPUTS)])
    snapshot = ", ".join(f"{n}: {'int' if n == 'month' else 'double'}" for n in SNAPSHOT)
    kinds = T._parse_datatype_string(f"error string, months int, {', '.join(f'{n} double' for n in _RESULTS)}, snapshots array<struct<{snapshot}>>")
    end = slim.mapInArrow(_fold(len(names)), T.StructType([*[T.StructField(n, slim.schema[n].dataType) for n in names], *kinds.fields]))
    real = F.col("balance") / F.col("inflation_index")
    growth = F.col("balance") - F.col("__start_balance") - F.col("contributions_nominal") + F.col("fees_nominal")
    growth_real = real - F.col("__start_balance") - F.col("contributions_real") + F.col("fees_real")
    return end.select(
        *keep,
        "error",
        "months",
        "inflation_index",
        F.col("balance").alias("balance_nominal"),
        real.alias("balance_real"),
        pension(F.col("balance"), F.col("coefficient"), 200).alias("pension_nominal"),
        pension(real, F.col("coefficient"), 200).alias("pension_real"),
        *[f"{t}_{m}" for t in _TOTALS for m in ("nominal", "real")],
        F.col("gain").alias("gain_nominal"),
        growth.alias("growth_nominal"),
        growth_real.alias("growth_real"),
        F.col("salary").alias("final_salary_nominal"),
        (F.col("salary") / F.col("inflation_index")).alias("final_salary_real"),
        "snapshots",
    )


def snapshots(projected: DataFrame, key: str = "scenario_id") -> DataFrame:
    """A row for each snapshot: at the start, each full year and the end."""
    return projected.select(key, F.inline("snapshots"))
