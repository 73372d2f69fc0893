"""Closed-form expectations of the projection, one row a case."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import projection, whatif

BASE = {
    "scenario_id": 0, "current_age": 30.0, "retirement_age": 40.0, "current_balance": 100000.0, "monthly_salary": 10000.0, "pensionable_salary": 10000.0, "inflation": 0.0, "mode": "fixed", "fixed_amount": 0.0, "fixed_grows": False,
    "employee_rate": 0.0, "employer_rate": 0.0, "severance_rate": 0.0, "salary_limit": 0.0, "blend": False, "protected_weight": 0.0, "protected_real": 0.0, "balance_fee": 0.0, "deposit_fee": 0.0, "coefficient": 200.0,
    "salary_phases": [(30.0, 40.0, 0.0, "nominal")], "return_phases": [(30.0, 40.0, 0.0, "nominal")], "breaks": [],
}


def pause(**more):
    row = {"id": "b", "start": 32.0, "months": 24.0, "contribution": 0.0, "resume": "projected", "restart_salary": 0.0} | more
    return tuple(row.values())


RESTART = {"monthly_salary": 10000.0, "salary_phases": [(30.0, 33.0, 0.1, "nominal")], "retirement_age": 33.0}
CASES = {
    "no return": ({}, "balance_nominal", 100000),
    "fixed contribution": ({"fixed_amount": 1000.0}, "balance_nominal", 100000 + 1000 * 120),
    "five per cent": ({"return_phases": [(30.0, 40.0, 0.05, "nominal")]}, "balance_nominal", 100000 * 1.05**10),
    "a break": ({"fixed_amount": 1000.0, "breaks": [pause()]}, "balance_nominal", 100000 + 1000 * 96),
    "a partly paid break": ({"fixed_amount": 1000.0, "breaks": [pause(contribution=250.0)]}, "balance_nominal", 100000 + 1000 * 96 + 250 * 24),
    "deposit fee": ({"fixed_amount": 1000.0, "deposit_fee": 0.1, "retirement_age": 31.0, "current_balance": 0.0}, "balance_nominal", 10800),
    "deposit fee total": ({"fixed_amount": 1000.0, "deposit_fee": 0.1, "retirement_age": 31.0, "current_balance": 0.0}, "fees_nominal", 1200),
    "no growth by fees alone": ({"fixed_amount": 1000.0, "deposit_fee": 0.1, "retirement_age": 31.0, "current_balance": 0.0}, "growth_nominal", 0),
    "balance fee": ({"balance_fee": 0.01, "retirement_age": 31.0}, "balance_nominal", 99000),
    "insured part": ({"mode": "percent", "pensionable_salary": 8000.0, "employee_rate": 0.1, "retirement_age": 31.0, "current_balance": 0.0}, "balance_nominal", 8000 * 0.1 * 12),
    "limit": ({"mode": "percent", "salary_limit": 5000.0, "employee_rate": 0.1, "retirement_age": 31.0, "current_balance": 0.0}, "balance_nominal", 5000 * 0.1 * 12),
    "return as inflation": ({"inflation": 0.02, "return_phases": [(30.0, 40.0, 0.02, "nominal")]}, "balance_real", 100000),
    "the last phase goes on": ({"return_phases": [(30.0, 35.0, 0.0, "nominal"), (35.0, 39.0, 0.1, "nominal")]}, "balance_nominal", 100000 * 1.1**5),
    "blend of weight one": ({"blend": True, "protected_weight": 1.0, "protected_real": 0.05}, "balance_nominal", 100000 * 1.05**10),
    "restart at a sum": (RESTART | {"breaks": [pause(start=31.0, resume="custom", restart_salary=5000.0, months=24.0)]}, "final_salary_nominal", 5000),
    "restart as before": ({"salary_phases": [(30.0, 34.0, 0.1, "nominal")], "retirement_age": 33.0, "breaks": [pause(start=31.0, resume="previous", months=12.0)]}, "final_salary_nominal", 11000 * 1.1),
    "a gap keeps the earlier phase": ({"return_phases": [(30.0, 31.0, 0.1, "nominal"), (39.0, 40.0, 0.1, "nominal")]}, "balance_nominal", 100000 * 1.1**10),
    "least coefficient": ({"coefficient": 0.5}, "pension_nominal", 100000),
}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in BASE) for r in rows], projection.SCENARIO)


@pytest.fixture(scope="module")
def results(spark):
    rows = [BASE | change | {"scenario_id": i} for i, (change, _, _) in enumerate(CASES.values())]
    return {r["scenario_id"]: r for r in projection.project(frame(spark, rows)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_closed_forms(results, name):
    _, column, expected = CASES[name]
    assert results[list(CASES).index(name)][column] == pytest.approx(expected, rel=1e-9, abs=1e-6)


def test_errors_stay_with_their_rows(spark):
    rows = [BASE, BASE | {"scenario_id": 1, "retirement_age": 30.0}, BASE | {"scenario_id": 2, "inflation": -1.0}, BASE | {"scenario_id": 3, "return_phases": [(30.0, 40.0, -1.0, "nominal")]}]
    out = {r["scenario_id"]: r["error"] for r in projection.project(frame(spark, rows)).select("scenario_id", "error").collect()}
    assert out[0] is None and all(out[i] for i in (1, 2, 3))


def test_accounts_balance(spark):
    row = BASE | {"fixed_amount": 900.0, "deposit_fee": 0.02, "balance_fee": 0.01, "return_phases": [(30.0, 40.0, 0.05, "real")], "inflation": 0.03}
    r = projection.project(frame(spark, [row])).first()
    assert r["balance_nominal"] == pytest.approx(100000 + r["net_contributions_nominal"] + r["gain_nominal"] - r["balance_fees_nominal"])
    assert len(r["snapshots"]) == 11 and r["snapshots"][-1]["month"] == 120


def test_later_retirement_gives_more(spark):
    row = BASE | {"fixed_amount": 900.0, "return_phases": [(30.0, 40.0, 0.04, "real")]}
    out = whatif.retirement_series(frame(spark, [row]), F.lit(38.0), F.lit(42.0)).orderBy("age").collect()
    assert [r["age"] for r in out] == [38.0, 39.0, 40.0, 41.0, 42.0]
    assert all(a["pension_real"] < b["pension_real"] for a, b in zip(out, out[1:], strict=False))


def test_empty_table(spark):
    assert projection.project(frame(spark, [])).collect() == []
