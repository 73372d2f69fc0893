"""Queries that cover every document and scenario, on a small table made here, against what follows from its numbers."""

from itertools import product

import duckdb
import pytest

from tidewright import plans
from tidewright.operators.payslip import CHOICES, MOST_RATE, MOST_TOTAL
from tidewright.plans import scenarios


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """35 customers: each remainder by 7 with each by 5."""
    folder = tmp_path_factory.mktemp("whole")
    rows = spark.range(1, 36).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "'BUILDING' AS c_mktsegment", "CAST(id * 10 AS DOUBLE) AS c_acctbal")
    rows.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def printed(ck: int) -> tuple[int, list[tuple[float | None, float | None]]]:
    """The salary on a customer's payslip, and each role's amount and rate."""
    salary = 8000 + 100 * (ck * 37 % 180)
    employee = {0: (0.07, None), 1: (None, 0.07), 2: (0.07, 0.05)}.get(ck % 5, (0.07, 0.07))
    return salary, [(None if a is None else a * salary, r) for a, r in (employee, (0.065, 0.065), (0.0833, 0.0833))]


def combinations(ck: int) -> int:
    """How many choices of a salary and, for each role, of an amount, a rate, both or neither keep the rules."""
    salary, roles = printed(ck)
    choices = [{(a, r), (a, None), (None, r), (None, None)} for a, r in roles]
    assert all(len(c) <= CHOICES for c in choices)
    n = 0
    for base, *chosen in product([salary, salary * 12] if ck % 7 == 0 else [salary], *choices):
        amounts, rates = [a for a, _ in chosen if a is not None], [r for _, r in chosen if r is not None]
        n += all(0 < a < base and a / base <= MOST_RATE for a in amounts) and all(0 < r <= MOST_RATE for r in rates) and sum(amounts) < base * MOST_TOTAL
    return n


def test_evaluate_tuple_counts_combinations_of_every_document(spark, customers):
    got = dict(map(tuple, plans.queries()["evaluate_tuple"](spark, customers).collect()))
    assert got == {ck: combinations(ck) for ck in range(1, 36)}


def test_contribution_options_of_all_roles(spark, customers):
    sure = 0.96 * 0.35 + 0.96 * 0.25 + 0.72 * 0.25 + 0.96 * 0.15
    expected = {}
    for ck in range(1, 36):
        for field, (a, r) in zip(("employeeContribution", "employerContribution", "severanceContribution"), printed(ck)[1], strict=True):
            both = [(a, r, 2 * sure + 0.2)] if a and r else []
            alone = [(a, None, sure)] * bool(a) + [(None, r, sure)] * bool(r)
            expected |= {(ck, field, i): x for i, x in enumerate(both + alone, 1)}
    rows = plans.queries()["contribution_options"](spark, customers).collect()
    got = {(x.doc_id, x.field, x.choice): (x.amount, x.rate, x.unary) for x in rows}
    assert len(got) == len(rows) and got.keys() == expected.keys()
    for k, (a, r, unary) in expected.items():
        assert got[k] == (a and pytest.approx(a, abs=0.006), r and pytest.approx(r), pytest.approx(unary, abs=1e-6))


def test_prev_salary_of_all_scenarios(spark, customers):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{customers}/customer.parquet/*.parquet'")
    expected = dict(con.sql(scenarios.fold_sql("SELECT k, salary FROM fin")).fetchall())
    got = dict(map(tuple, plans.queries()["prev_salary"](spark, customers).collect()))
    assert len(got) == 35 and got == {k: pytest.approx(v, abs=0.006) for k, v in expected.items()}


def test_flatten_words_reads_every_document(spark, customers):
    out = plans.queries()["src_flatten_words"](spark, customers)
    assert "Filter" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, out.collect())) == [(ck, i, w) for ck in range(1, 36) if ck % 3 for i, w in enumerate(("BUILDING", "7"))]
