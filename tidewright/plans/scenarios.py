"""Queries over scenarios that are derived from the customer table, and their SQL.

SEED is plain SQL that both engines run: it's the input. The oracles compute everything else on their own: phases and
breaks are tables there, months are rows, and the projection is a recursive query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import rates
from tidewright.operators import projection, state, whatif
from tidewright.session import ready

YEAR = 2026
SEED = """SELECT CAST(c_custkey AS BIGINT) AS scenario_id, CAST(25 + c_custkey % 30 AS DOUBLE) AS current_age,
 CAST(60 + c_custkey % 9 AS DOUBLE) + CASE WHEN c_custkey % 7 = 0 THEN 75e-2 ELSE 0e0 END AS retirement_age,
 greatest(c_acctbal, 0e0) * 30e0 AS current_balance, 8000e0 + abs(c_acctbal) AS monthly_salary,
 (8000e0 + abs(c_acctbal)) * CASE WHEN c_custkey % 3 = 0 THEN 8e-1 ELSE 1e0 END AS pensionable_salary,
 CAST(c_custkey % 4 AS DOUBLE) / 100e0 AS inflation, CASE WHEN c_custkey % 5 = 0 THEN 'fixed' ELSE 'percent' END AS mode,
 1500e0 AS fixed_amount, c_custkey % 2 = 0 AS fixed_grows, 6e-2 AS employee_rate, 65e-3 AS employer_rate, 833e-4 AS severance_rate,
 CASE WHEN c_custkey % 11 = 0 THEN 12000e0 ELSE 0e0 END AS salary_limit, c_custkey % 6 = 0 AS blend, 3e-1 AS protected_weight, 515e-4 AS protected_real,
 5e-3 AS balance_fee, CAST(c_custkey % 3 AS DOUBLE) / 100e0 AS deposit_fee, CAST(180 + 10 * (c_custkey % 6) AS DOUBLE) AS coefficient,
 CAST(c_custkey AS BIGINT) AS ck FROM customer"""

_SPARK_ARRAYS = f"""
 cast(array(named_struct('start', current_age, 'end', current_age + 10, 'rate', 2e-2, 'kind', 'real'), named_struct('start', current_age + 10, 'end', retirement_age - 2, 'rate', 1e-2, 'kind', 'nominal')) AS array<{projection.PHASE}>) AS salary_phases,
 cast(array(named_struct('start', current_age + 12, 'end', retirement_age, 'rate', 35e-3, 'kind', CASE WHEN ck % 2 = 0 THEN 'nominal' ELSE 'real' END), named_struct('start', current_age, 'end', current_age + 15, 'rate', 5e-2, 'kind', 'real')) AS array<{projection.PHASE}>) AS return_phases,
 cast(CASE ck % 4 WHEN 1 THEN array(named_struct('id', 'a', 'start', current_age + 5, 'months', 18e0, 'contribution', 250e0, 'resume', 'previous', 'restart_salary', 0e0))
   WHEN 2 THEN array(named_struct('id', 'b', 'start', current_age + 4, 'months', 6e0, 'contribution', 0e0, 'resume', 'projected', 'restart_salary', 0e0), named_struct('id', 'a', 'start', current_age + 3, 'months', 12e0, 'contribution', 100e0, 'resume', 'custom', 'restart_salary', 5000e0))
   WHEN 3 THEN array(named_struct('id', 'c', 'start', current_age + 7, 'months', 9e0, 'contribution', 0e0, 'resume', 'custom', 'restart_salary', 7000e0)) ELSE array() END AS array<{projection.BREAK}>) AS breaks"""

#: The same phases and breaks as tables, for the oracles.
_TABLES = """sph AS (
  SELECT scenario_id AS k, 0 AS ord, current_age AS s, current_age + 10 AS e, 2e-2 AS rate, 'real' AS kind FROM seed
  UNION ALL SELECT scenario_id, 1, current_age + 10, retirement_age - 2, 1e-2, 'nominal' FROM seed
), rph AS (
  SELECT scenario_id AS k, 0 AS ord, current_age + 12 AS s, retirement_age AS e, 35e-3 AS rate, CASE WHEN ck % 2 = 0 THEN 'nominal' ELSE 'real' END AS kind FROM seed
  UNION ALL SELECT scenario_id, 1, current_age, current_age + 15, 5e-2, 'real' FROM seed
), brk AS (
  SELECT scenario_id AS k, 0 AS ord, 'a' AS id, current_age + 5 AS s, 18e0 AS months, 250e0 AS contribution, 'previous' AS resume, 0e0 AS restart FROM seed WHERE ck % 4 = 1
  UNION ALL SELECT scenario_id, 0, 'b', current_age + 4, 6e0, 0e0, 'projected', 0e0 FROM seed WHERE ck % 4 = 2
  UNION ALL SELECT scenario_id, 1, 'a', current_age + 3, 12e0, 100e0, 'custom', 5000e0 FROM seed WHERE ck % 4 = 2
  UNION ALL SELECT scenario_id, 0, 'c', current_age + 7, 9e0, 0e0, 'custom', 7000e0 FROM seed WHERE ck % 4 = 3
)"""

_AS_OF = "arg_max({0}, {{'c': ag < e, 's': s, 'e': e, 'o': ord}}) FILTER (s <= ag)"
_FIRST = "arg_min({0}, {{'s': s, 'e': e, 'o': ord}})"

#: From scn (variants, key k), sph, rph and brk: fin (the last state of each k) and snap (its yearly rows).
_FOLD = f"""t AS (
  SELECT *, CAST(greatest(1, floor((retirement_age - current_age) * 12 + 5e-1)) AS INT) AS months, pow(1 + inflation, 1 / 12e0) - 1 AS mi,
    CASE WHEN monthly_salary > 0 THEN pensionable_salary / monthly_salary ELSE 1 END AS ratio, 1 - pow(1 - balance_fee, 1 / 12e0) AS af,
    CASE WHEN salary_limit > 0 THEN salary_limit ELSE 'inf'::double END AS cap, employee_rate + employer_rate + severance_rate AS rates,
    pow(1 + ((1 + protected_real) * (1 + inflation) - 1), 1 / 12e0) - 1 AS safe FROM scn
), aa AS (SELECT k, m, current_age + m / 12e0 AS ag, current_age + (m + 1) / 12e0 AS nx FROM (SELECT k, current_age, unnest(range(0, months)) AS m FROM t)
), sp AS (SELECT x.*, pow(1 + CASE WHEN kind = 'real' THEN (1 + rate) * (1 + inflation) - 1 ELSE rate END, 1 / 12e0) - 1 AS mr FROM sph x JOIN t USING (k)
), rp AS (SELECT x.*, pow(1 + CASE WHEN kind = 'real' THEN (1 + rate) * (1 + inflation) - 1 ELSE rate END, 1 / 12e0) - 1 AS mr FROM rph x JOIN t USING (k)
), sg AS (SELECT k, m, coalesce({_AS_OF.format("mr")}, {_FIRST.format("mr")}) AS g FROM aa JOIN sp USING (k) GROUP BY k, m
), rg AS (SELECT k, m, coalesce({_AS_OF.format("mr")}, {_FIRST.format("mr")}) AS r FROM aa JOIN rp USING (k) GROUP BY k, m
), bg AS (
  SELECT k, m, arg_max({{'id': id, 'c': contribution, 'how': resume, 'to': restart}}, {{'s': s, 'o': ord}}) FILTER (s <= ag AND ag < s + months / 12) AS pause,
    count(*) FILTER (s <= nx AND nx < s + months / 12) > 0 AS goes FROM aa LEFT JOIN brk USING (k) GROUP BY k, m
), cal AS (SELECT k, list({{'g': g, 'r': r, 'p': pause, 'n': goes}} ORDER BY m) AS cal FROM sg JOIN rg USING (k, m) JOIN bg USING (k, m) GROUP BY k
), z AS (SELECT t.*, cal FROM t JOIN cal USING (k)
), f AS (
  SELECT k, 0 AS m, monthly_salary AS salary, current_balance AS bal, 1e0 AS idx, 0e0 AS cn, 0e0 AS cr, 0e0 AS nn, 0e0 AS nr, 0e0 AS fn, 0e0 AS fr, 0e0 AS dn, 0e0 AS dr, 0e0 AS bn, 0e0 AS br, 0e0 AS gain,
    NULL::varchar AS pid, NULL::double AS held FROM z
  UNION ALL
  SELECT k, m + 1, CASE WHEN over AND how = 'previous' AND held2 IS NOT NULL THEN held2 WHEN over AND how = 'custom' THEN greatest(0, back) ELSE salary * (1 + g) END,
    full_ - full_ * af, idx2, cn + gross, cr + gross / idx2, nn + (gross - fee), nr + (gross - fee) / idx2, fn + fee + full_ * af, fr + fee / idx2 + full_ * af / idx2,
    dn + fee, dr + fee / idx2, bn + full_ * af, br + full_ * af / idx2, gain + won, CASE WHEN NOT over THEN pid2 END, CASE WHEN NOT over THEN held2 END
  FROM (SELECT *, paid + won AS full_ FROM (SELECT *, paid * earned AS won FROM (SELECT *, bal + (gross - fee) AS paid FROM (SELECT *, gross * deposit_fee AS fee FROM (
    SELECT f.*, z.deposit_fee, z.af, idx * (1 + mi) AS idx2, c.g, c.p IS NOT NULL AND NOT c.n AS over, c.p.how AS how, c.p."to" AS back,
      CASE WHEN c.p IS NOT NULL AND pid IS DISTINCT FROM c.p.id THEN salary ELSE held END AS held2, CASE WHEN c.p IS NOT NULL AND pid IS DISTINCT FROM c.p.id THEN c.p.id ELSE pid END AS pid2,
      CASE WHEN blend THEN protected_weight * safe + (1 - protected_weight) * c.r ELSE c.r END AS earned,
      CASE WHEN c.p IS NOT NULL THEN greatest(0, c.p.c) WHEN mode = 'percent' THEN greatest(0, least(salary * ratio, cap) * rates)
        ELSE fixed_amount * CASE WHEN fixed_grows AND monthly_salary > 0 THEN salary / monthly_salary ELSE 1 END END AS gross
    FROM (SELECT f.*, z.cal[f.m + 1] AS c FROM f JOIN z USING (k) WHERE f.m < z.months) f JOIN z USING (k)
  )))))
), fin AS (SELECT f.*, z.months, z.coefficient, z.current_balance, z.current_age, z.retirement_age FROM f JOIN z ON f.k = z.k AND f.m = z.months
), snap AS (SELECT f.*, z.months, z.current_age FROM f JOIN z USING (k) WHERE f.m % 12 = 0 OR f.m = z.months)"""


def fold_sql(select: str, scn: str = "SELECT scenario_id AS k, * FROM seed", tables: str = _TABLES, more: str = "") -> str:
    return f"WITH RECURSIVE seed AS ({SEED}), {more}{tables}, scn AS ({scn}), {_FOLD}\n{select}"


_MONEY = {
    "inflation_index": "idx",
    "balance_nominal": "bal",
    "balance_real": "bal / idx",
    "pension_nominal": "bal / greatest(1, coefficient)",
    "pension_real": "bal / idx / greatest(1, coefficient)",
    "contributions_nominal": "cn",
    "contributions_real": "cr",
    "net_contributions_nominal": "nn",
    "net_contributions_real": "nr",
    "fees_nominal": "fn",
    "fees_real": "fr",
    "deposit_fees_nominal": "dn",
    "deposit_fees_real": "dr",
    "balance_fees_nominal": "bn",
    "balance_fees_real": "br",
    "gain_nominal": "gain",
    "growth_nominal": "bal - current_balance - cn + fn",
    "growth_real": "bal / idx - current_balance - cr + fr",
    "final_salary_nominal": "salary",
    "final_salary_real": "salary / idx",
}
_SNAP = {
    "age": "current_age + m / 12e0",
    "nominal_balance": "bal",
    "real_balance": "bal / idx",
    "nominal_salary": "salary",
    "real_salary": "salary / idx",
    "contributions_nominal": "cn",
    "contributions_real": "cr",
    "net_contributions_nominal": "nn",
    "net_contributions_real": "nr",
    "fees_nominal": "fn",
    "fees_real": "fr",
    "gain_nominal": "gain",
}


def r2(expr: str, name: str, digits: int = 2) -> str:
    """Rounded by the same steps on both sides."""
    return f"floor(({expr}) * {10**digits}e0 + 5e-1) / {10**digits}e0 AS {name}"


def cents(df: DataFrame, *names: str, digits: int = 2) -> list[Column]:
    return [(F.floor(F.col(n) * float(10**digits) + 0.5) / float(10**digits)).alias(n) for n in names]


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark).read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("tidewright_customer")
    seed = spark.sql(SEED.replace("FROM customer", "FROM tidewright_customer")).repartition(spark.sparkContext.defaultParallelism)  # small rows, long folds
    return seed.selectExpr("*", *[x.strip() for x in _split(_SPARK_ARRAYS)])


def _split(text: str) -> list[str]:
    """The three array columns: they begin on lines of their own with cast(."""
    parts, lines = [], text.strip().split("\n")
    for line in lines:
        if line.strip().startswith("cast("):
            parts.append(line)
        else:
            parts[-1] += "\n" + line
    return [p.strip().rstrip(",") for p in parts]


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of a scenario table (or of spark and a folder) under its name, with its SQL."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(scenarios(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return register


def seed_sql(select: str, more: str = "") -> str:
    return f"WITH seed AS ({SEED}), {more}{_TABLES}\n{select}"


# ---------------------------------------------------------------- the projection


@query(fold_sql(f"SELECT k AS scenario_id, months, {', '.join(r2(x, n, 6 if n == 'inflation_index' else 2) for n, x in _MONEY.items())} FROM fin"))
def project(s: DataFrame) -> DataFrame:
    out = projection.project(s)
    names = [n for n in _MONEY if n != "inflation_index"]
    return out.select("scenario_id", "months", *cents(out, "inflation_index", digits=6), *cents(out, *names))


@query(fold_sql(f"SELECT k AS scenario_id, m AS month, {', '.join(r2(x, n) for n, x in _SNAP.items())} FROM snap"))
def snapshots(s: DataFrame) -> DataFrame:
    out = projection.snapshots(projection.project(s))
    return out.select("scenario_id", "month", *cents(out, *_SNAP))


_TOTALS = [n for n in _MONEY if "contributions" in n or "fees" in n or n == "gain_nominal"]


@query(fold_sql(f"SELECT k AS scenario_id, {', '.join(r2(_MONEY[n], n) for n in _TOTALS)} FROM fin"))
def running_totals(s: DataFrame) -> DataFrame:
    out = projection.project(s)
    return out.select("scenario_id", *cents(out, *_TOTALS))


@query(fold_sql(f"SELECT k AS scenario_id, {r2(_MONEY['growth_nominal'], 'growth_nominal')}, {r2('gain', 'gain_nominal')}, {r2(_MONEY['growth_real'], 'growth_real')} FROM fin"))
def growth_decomposition(s: DataFrame) -> DataFrame:
    out = projection.project(s)
    return out.select("scenario_id", *cents(out, "growth_nominal", "gain_nominal", "growth_real"))


@query(seed_sql("SELECT scenario_id, m AS month FROM (SELECT scenario_id, unnest(range(0, n + 1)) AS m, n FROM (SELECT scenario_id, CAST(floor((retirement_age - current_age) * 12 + 5e-1) AS INT) AS n FROM seed)) WHERE m % 12 = 0 OR m = n"))
def year_end_sampling(s: DataFrame) -> DataFrame:
    return projection.snapshots(projection.project(s)).select("scenario_id", "month")


@query(fold_sql(f"SELECT k AS scenario_id, {r2('salary', 'final_salary_nominal')} FROM fin"))
def prev_salary(s: DataFrame) -> DataFrame:
    """Final salaries of all scenarios; they are held over a break that resumes with the previous one, and over no other."""
    out = projection.project(s)
    return out.select("scenario_id", *cents(out, "final_salary_nominal"))


_CALENDAR = "m AS (SELECT scenario_id AS k, at_ AS m, current_age + at_ / 12e0 AS ag, current_age + (at_ + 1) / 12e0 AS nx FROM (SELECT *, unnest(range(0, CAST(floor((retirement_age - current_age) * 12 + 5e-1) AS INT))) AS at_ FROM seed)), "


@query(seed_sql("SELECT m.k AS scenario_id, m AS month, count(*) FILTER (s <= nx AND nx < s + months / 12) > 0 AS goes_on FROM m JOIN brk ON brk.k = m.k AND s <= ag AND ag < s + months / 12 OR brk.k = m.k AND s <= nx AND nx < s + months / 12 GROUP BY m.k, m HAVING count(*) FILTER (s <= ag AND ag < s + months / 12) > 0", _CALENDAR))
def next_break_peek(s: DataFrame) -> DataFrame:
    """For months in a break, whether the next month is in one too; a salary resumes where it isn't."""
    return projection.break_calendar(s).select("scenario_id", "month", "goes_on")


def _whole_years(s: DataFrame) -> DataFrame:
    last = F.floor(F.col("retirement_age") - F.col("current_age")).cast("int")
    return s.withColumn("year", F.explode(F.sequence(F.lit(-1), last + 1))).withColumn("at", F.col("current_age") + F.col("year"))


_YEARS = "y AS (SELECT *, scenario_id AS k, current_age + unnest(range(-1, CAST(floor(retirement_age - current_age) AS INT) + 2)) AS ag FROM seed), "


@query(seed_sql(f"SELECT y.k AS scenario_id, ag AS age, coalesce({_AS_OF.format('rate')}, {_FIRST.format('rate')}) AS rate, coalesce({_AS_OF.format('s')}, {_FIRST.format('s')}) AS start FROM y JOIN rph USING (k) GROUP BY y.k, ag", _YEARS))
def asof_phase(s: DataFrame) -> DataFrame:
    phase = projection.phase_at(projection.ordered(F.col("return_phases")), F.col("at"))
    return _whole_years(s).select("scenario_id", F.col("at").alias("age"), phase["rate"].alias("rate"), phase["start"].alias("start"))


@query(seed_sql("SELECT y.k AS scenario_id, ag AS age, arg_max(id, {'s': s, 'o': ord}) FILTER (s <= ag AND ag < s + months / 12) AS break_id FROM y LEFT JOIN brk USING (k) GROUP BY y.k, ag", _YEARS))
def interval_break(s: DataFrame) -> DataFrame:
    ages = _whole_years(s).withColumn("sorted", projection._breaks())
    return ages.select("scenario_id", F.col("at").alias("age"), projection.break_at(F.col("sorted"), F.col("at"))["id"].alias("break_id"))


# ---------------------------------------------------------------- sweeps and comparisons

_LOW = "greatest(current_age + 1, greatest(55e0, retirement_age - 4))"
_HIGH = f"least(80e0, greatest(retirement_age + 4, {_LOW} + 4))"
_AGES = f"SELECT *, unnest(range(CAST(ceil({_LOW}) AS INT), CAST(floor({_HIGH}) AS INT) + 1)) AS swept FROM seed"
_SWEPT = """scn0 AS (SELECT * EXCLUDE (retirement_age), CAST(swept AS DOUBLE) AS retirement_age, scenario_id * 100 + swept AS k, retirement_age AS chosen FROM ({ages}) WHERE swept > current_age),
sph AS (SELECT x.k, ord, s, CASE WHEN ord = 1 THEN greatest(x.retirement_age, e) ELSE e END AS e, rate, kind FROM scn0 x JOIN sph0 p ON p.k = x.scenario_id),
rph AS (SELECT x.k, ord, s, CASE WHEN ord = 0 THEN greatest(x.retirement_age, e) ELSE e END AS e, rate, kind FROM scn0 x JOIN rph0 p ON p.k = x.scenario_id),
brk AS (SELECT x.k, b.* EXCLUDE (k) FROM scn0 x JOIN brk0 b ON b.k = x.scenario_id)"""
_SWEEP_TABLES = _TABLES.replace("sph AS", "sph0 AS").replace("rph AS", "rph0 AS").replace("brk AS", "brk0 AS") + ", " + _SWEPT.format(ages=_AGES)
_SERIES = {"balance_real": "bal / idx", "pension_real": "bal / idx / greatest(1, coefficient)", "balance_nominal": "bal", "pension_nominal": "bal / greatest(1, coefficient)"}


def _bounds() -> tuple[Column, Column]:
    return whatif.explorer_bounds(F.col("current_age"), F.col("retirement_age"))


@query(fold_sql(f"SELECT k // 100 AS scenario_id, retirement_age AS age, {', '.join(r2(x, n) for n, x in _SERIES.items())} FROM fin", "SELECT * FROM scn0", _SWEEP_TABLES))
def retirement_series(s: DataFrame) -> DataFrame:
    out = whatif.retirement_series(s, *_bounds())
    return out.select("scenario_id", "age", *cents(out, *_SERIES))


@query(seed_sql(f"SELECT scenario_id, CAST(swept AS DOUBLE) AS retirement_age, greatest(swept, current_age + 15) AS unused FROM ({_AGES}) WHERE swept > current_age").replace(", greatest(swept, current_age + 15) AS unused", ""))
def age_sweep(s: DataFrame) -> DataFrame:
    return whatif.age_sweep(s.withColumns(dict(zip(("lo", "hi"), _bounds(), strict=True))), F.col("lo"), F.col("hi")).select("scenario_id", "retirement_age")


@query(seed_sql(f"SELECT scenario_id, {_LOW} AS low, {_HIGH} AS high FROM seed"))
def explorer_bounds(s: DataFrame) -> DataFrame:
    low, high = _bounds()
    return s.select("scenario_id", low.alias("low"), high.alias("high"))


@query(
    fold_sql(
        f"SELECT scenario_id, age, pension_real, shown FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY age) AS shown FROM (SELECT fin.k // 100 AS scenario_id, fin.retirement_age AS age, {r2('bal / idx / greatest(1, fin.coefficient)', 'pension_real')}, chosen, row_number() OVER (PARTITION BY fin.k // 100 ORDER BY fin.k) - 1 AS place, count(*) OVER (PARTITION BY fin.k // 100) AS n FROM fin JOIN scn0 USING (k)) WHERE place = 0 OR place = n - 1 OR age = chosen OR place % 2 = 0) WHERE shown <= 8",
        "SELECT * FROM scn0",
        _SWEEP_TABLES,
    )
)
def explorer_pick(s: DataFrame) -> DataFrame:
    out = whatif.explorer_pick(whatif.retirement_series(s, *_bounds()), s)
    return out.select("scenario_id", "age", *cents(out, "pension_real"), "shown")


@query(seed_sql("SELECT p.k AS scenario_id, ord, CASE WHEN ord = 0 THEN greatest(seed.retirement_age + 3, e) ELSE e END AS e FROM rph p JOIN seed ON seed.scenario_id = p.k"))
def extend_last_phase(s: DataFrame) -> DataFrame:
    out = s.withColumn("p", whatif.extend_last_phase(F.col("return_phases"), F.col("retirement_age") + 3))
    return out.select("scenario_id", F.posexplode("p").alias("ord", "x")).select("scenario_id", "ord", F.col("x.end").alias("e"))


_RETURN_TABLES = _TABLES.replace("sph AS", "sph0 AS").replace("rph AS", "rph0 AS").replace("brk AS", "brk0 AS") + """, scn0 AS (SELECT *, scenario_id * 100 + CAST(swept * 100 AS INT) AS k FROM (SELECT *, unnest([2e-2, 4e-2, 6e-2]) AS swept FROM seed)),
sph AS (SELECT x.k, p.* EXCLUDE (k) FROM scn0 x JOIN sph0 p ON p.k = x.scenario_id), brk AS (SELECT x.k, b.* EXCLUDE (k) FROM scn0 x JOIN brk0 b ON b.k = x.scenario_id),
rph AS (SELECT k, 0 AS ord, current_age AS s, retirement_age AS e, swept AS rate, 'real' AS kind FROM scn0)"""


@query(fold_sql(f"SELECT k // 100 AS scenario_id, CAST(k % 100 AS DOUBLE) / 100e0 AS swept, {r2('bal / idx', 'balance_real')}, {r2('bal / idx / greatest(1, coefficient)', 'pension_real')} FROM fin", "SELECT * FROM scn0", _RETURN_TABLES))
def return_sweep(s: DataFrame) -> DataFrame:
    out = projection.project(whatif.return_sweep(s), ["scenario_id", "swept"])
    return out.select("scenario_id", "swept", *cents(out, "balance_real", "pension_real"))


@query(fold_sql(f"SELECT k AS scenario_id, coefficient, {r2('bal / idx / greatest(1, coefficient)', 'pension_real')} FROM (SELECT * EXCLUDE (coefficient), unnest(list_sort(list_distinct([180e0, 200e0, 220e0, 240e0, coefficient]))[1:5]) AS coefficient FROM fin)"))
def coefficient_sweep(s: DataFrame) -> DataFrame:
    out = whatif.coefficient_sweep(projection.project(s, ["scenario_id", "coefficient"]), F.col("coefficient"))
    return out.select("scenario_id", "coefficient", *cents(out, "pension_real"))


_FEE_TABLES = _TABLES.replace("sph AS", "sph0 AS").replace("rph AS", "rph0 AS").replace("brk AS", "brk0 AS") + """, scn0 AS (SELECT * EXCLUDE (balance_fee), scenario_id * 2 + v AS k, CASE WHEN v = 1 THEN 1e-3 ELSE balance_fee END AS balance_fee FROM (SELECT *, unnest([0, 1]) AS v FROM seed)),
sph AS (SELECT x.k, p.* EXCLUDE (k) FROM scn0 x JOIN sph0 p ON p.k = x.scenario_id), rph AS (SELECT x.k, p.* EXCLUDE (k) FROM scn0 x JOIN rph0 p ON p.k = x.scenario_id), brk AS (SELECT x.k, b.* EXCLUDE (k) FROM scn0 x JOIN brk0 b ON b.k = x.scenario_id)"""


@query(fold_sql(f"SELECT a.k // 2 AS scenario_id, {', '.join(r2(f'b.{n} - a.{n}', f'{n}_delta', 1) for n in _SERIES)} FROM v a JOIN v b ON a.k % 2 = 0 AND b.k = a.k + 1", "SELECT * FROM scn0", _FEE_TABLES).replace("\nSELECT a.k", f", v AS (SELECT k, {', '.join(f'{x} AS {n}' for n, x in _SERIES.items())} FROM fin)\nSELECT a.k"))
def compare_scenarios(s: DataFrame) -> DataFrame:
    """A lower fee on the balance against the scenario's own."""
    out = whatif.compare(projection.project(s), projection.project(s.withColumn("balance_fee", F.lit(1e-3))))
    return out.select("scenario_id", *cents(out, *[f"{n}_delta" for n in _SERIES], digits=1))


_NO_BREAKS = _FEE_TABLES.replace(" * EXCLUDE (balance_fee),", " *,").replace(", CASE WHEN v = 1 THEN 1e-3 ELSE balance_fee END AS balance_fee", "").replace("JOIN brk0 b ON b.k = x.scenario_id)", "JOIN brk0 b ON b.k = x.scenario_id WHERE v = 0)")


@query(fold_sql(f"SELECT a.k // 2 AS scenario_id, coalesce(n, 0) AS break_months, {r2('b.bal / b.idx / greatest(1, b.coefficient) - a.bal / a.idx / greatest(1, a.coefficient)', 'pension_lost', 1)} FROM fin a JOIN fin b ON a.k % 2 = 0 AND b.k = a.k + 1 LEFT JOIN (SELECT k, sum(months) AS n FROM brk0 GROUP BY k) x ON x.k = a.k // 2", "SELECT * FROM scn0", _NO_BREAKS))
def compare_no_break(s: DataFrame) -> DataFrame:
    out = whatif.effect_of_breaks(s)
    return out.select("scenario_id", "break_months", *cents(out, "pension_lost", digits=1))


_PREVIOUS = _SWEEP_TABLES.replace(_AGES, "SELECT *, unnest(CASE WHEN p = floor(p) THEN [CAST(p AS INT), -1] ELSE [-1] END) AS swept FROM (SELECT *, greatest(current_age + 1, retirement_age - 1) AS p FROM seed)").replace("WHERE swept > current_age", "WHERE swept > current_age OR swept = -1")
_PREVIOUS = _PREVIOUS.replace("CAST(swept AS DOUBLE) AS retirement_age, scenario_id * 100 + swept AS k", "CASE WHEN swept = -1 THEN retirement_age ELSE CAST(swept AS DOUBLE) END AS retirement_age, scenario_id * 2 + CASE WHEN swept = -1 THEN 0 ELSE 1 END AS k").replace("greatest(x.retirement_age, e)", "CASE WHEN x.k % 2 = 1 THEN greatest(x.retirement_age, e) ELSE e END")


@query(fold_sql(f"SELECT a.k // 2 AS scenario_id, {r2('coalesce(a.bal / a.idx / greatest(1, a.coefficient) - b.bal / b.idx / greatest(1, b.coefficient), 0)', 'pension_gained', 1)} FROM (SELECT * FROM fin WHERE k % 2 = 0) a LEFT JOIN fin b ON b.k = a.k + 1", "SELECT * FROM scn0", _PREVIOUS))
def compare_prev_age(s: DataFrame) -> DataFrame:
    out = whatif.effect_of_last_year(s)
    return out.select("scenario_id", *cents(out, "pension_gained", digits=1))


_SAVED = "SELECT scenario_id AS k, * FROM seed WHERE scenario_id IN (SELECT scenario_id FROM seed ORDER BY current_balance DESC, scenario_id LIMIT 4)"


@query(
    fold_sql(
        "SELECT measure, " + ", ".join(f"max(value) FILTER (place = {i + 1}) AS scenario_{i + 1}" for i in range(4)) + " FROM (SELECT place, unnest(['current_age', 'retirement_age', 'balance_real', 'pension_real', 'coefficient']) AS measure, "
        "unnest([current_age, retirement_age, floor(bal / idx * 100e0 + 5e-1) / 100e0, floor(bal / idx / greatest(1, coefficient) * 100e0 + 5e-1) / 100e0, coefficient]) AS value FROM (SELECT *, row_number() OVER (ORDER BY current_balance DESC, k) AS place FROM fin)) GROUP BY measure",
        _SAVED,
    )
)
def scenario_table(s: DataFrame) -> DataFrame:
    """The four scenarios with the largest balances side by side: a report with that limit."""
    from pyspark.sql import Window

    best = s.orderBy(F.col("current_balance").desc(), "scenario_id").limit(4)
    saved = best.withColumn("saved_order", F.row_number().over(Window.orderBy(F.col("current_balance").desc(), "scenario_id"))).withColumn("name", F.concat(F.lit("scenario "), "scenario_id"))
    out = whatif.scenario_table(saved)
    return out.select("measure", *cents(out, *[f"scenario_{i + 1}" for i in range(4)]))


@query(fold_sql(f"SELECT k AS scenario_id, {r2('greatest(1, max(bal / idx)) * 108e-2', 'top')} FROM snap GROUP BY k"))
def chart_domain(s: DataFrame) -> DataFrame:
    out = projection.snapshots(projection.project(s)).groupBy("scenario_id").agg(whatif.chart_domain(F.col("real_balance")).alias("top"))
    return out.select("scenario_id", *cents(out, "top"))


@query(seed_sql("SELECT scenario_id, coalesce(sum(months), 0) AS break_months FROM seed LEFT JOIN brk ON k = scenario_id GROUP BY scenario_id"))
def break_months(s: DataFrame) -> DataFrame:
    return s.select("scenario_id", F.aggregate("breaks", F.lit(0.0), lambda a, b: a + b["months"]).alias("break_months"))


@query(seed_sql("SELECT scenario_id, current_balance / greatest(1, CASE WHEN c = 0 THEN 1 ELSE c END) AS pension FROM (SELECT *, CAST(ck % 5 AS DOUBLE) * 50 - 50 AS c FROM seed)"))
def pension_at_coefficient(s: DataFrame) -> DataFrame:
    return s.select("scenario_id", rates.pension(F.col("current_balance"), (F.col("ck") % 5).cast("double") * 50 - 50).alias("pension"))


# ---------------------------------------------------------------- scenario fields


@query(seed_sql("SELECT scenario_id, CASE WHEN mode = 'fixed' THEN fixed_amount ELSE least(pensionable_salary, CASE WHEN salary_limit > 0 THEN salary_limit ELSE 1e300 END) * (employee_rate + employer_rate + severance_rate) END AS contribution FROM seed"))
def current_contribution(s: DataFrame) -> DataFrame:
    return s.select("scenario_id", whatif.current_contribution().alias("contribution"))


@query(seed_sql("SELECT scenario_id, greatest(0, current_balance) + greatest(0, CASE WHEN ck % 4 = 0 THEN 0 ELSE 1000e0 * (ck % 9 - 3) END) AS current_balance FROM seed"))
def state_for_projection(s: DataFrame) -> DataFrame:
    more = F.when(F.col("ck") % 4 != 0, 1000.0 * (F.col("ck") % 9 - 3))
    return whatif.for_projection(s.withColumn("additional_balance", more)).select("scenario_id", "current_balance")


_PRESET = "CASE ck % 4 WHEN 0 THEN 'conservative' WHEN 1 THEN 'growth' WHEN 2 THEN 'base' ELSE 'other' END"


@query(seed_sql(f"SELECT scenario_id, CASE WHEN {_PRESET} = 'conservative' THEN 230e0 WHEN {_PRESET} = 'growth' THEN 190e0 ELSE 200e0 END AS coefficient, i AS place, CASE {_PRESET} WHEN 'conservative' THEN 4e-2 WHEN 'growth' THEN 6e-2 ELSE CASE i WHEN 0 THEN 55e-3 ELSE 45e-3 END END AS rate, CASE WHEN {_PRESET} IN ('conservative', 'growth') OR i = 1 THEN retirement_age ELSE least(retirement_age, current_age + 15) END AS e FROM (SELECT *, unnest(CASE WHEN {_PRESET} IN ('conservative', 'growth') OR current_age + 15 >= retirement_age THEN [0] ELSE [0, 1] END) AS i FROM seed)"))
def apply_preset(s: DataFrame) -> DataFrame:
    out = whatif.apply_preset(s, F.expr(_PRESET))
    return out.select("scenario_id", "coefficient", F.posexplode("return_phases").alias("place", "p")).select("scenario_id", "coefficient", "place", F.col("p.rate").alias("rate"), F.col("p.end").alias("e"))


@query(seed_sql(f"SELECT scenario_id, CASE WHEN ck % 5 = 4 THEN NULL WHEN {_PRESET} = 'other' THEN 'base' ELSE {_PRESET} END AS preset FROM seed"))
def detect_preset(s: DataFrame) -> DataFrame:
    out = whatif.apply_preset(s, F.expr(_PRESET)).withColumn("coefficient", F.when(F.col("ck") % 5 == 4, 333.0).otherwise(F.col("coefficient")))
    return out.select("scenario_id", whatif.detect_preset().alias("preset"))


@query(seed_sql("SELECT scenario_id, CASE ck % 3 WHEN 0 THEN 0 WHEN 1 THEN inflation ELSE inflation + 1e-2 END AS salary_rate, CASE ck % 3 WHEN 0 THEN 2e-2 WHEN 1 THEN 4e-2 ELSE 6e-2 END AS return_rate FROM seed"))
def simple_paths(s: DataFrame) -> DataFrame:
    career = whatif.career_path(F.expr("CASE ck % 3 WHEN 0 THEN 'steady' WHEN 1 THEN 'inflation' ELSE 'aboveInflation' END"))
    invest = whatif.investment_path(F.expr("CASE ck % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'base' ELSE 'high' END"))
    return s.select("scenario_id", F.get(career, 0)["rate"].alias("salary_rate"), F.get(invest, 0)["rate"].alias("return_rate"))


@query(seed_sql("SELECT scenario_id, unnest([0, 1, 2]) AS place, unnest([current_age, current_age + 10, m]) AS s, unnest([current_age + 10, m, retirement_age - 2]) AS e FROM (SELECT *, greatest(current_age + 1, floor((current_age + 10 + retirement_age - 2) / 2 + 5e-1)) AS m FROM seed) WHERE retirement_age - 12 - current_age >= 2 UNION ALL SELECT k, ord, s, e FROM sph JOIN seed ON k = scenario_id WHERE retirement_age - 12 - current_age < 2"))
def split_last_phase(s: DataFrame) -> DataFrame:
    out = s.withColumn("p", whatif.split_last_phase(F.col("salary_phases"), F.col("current_age")))
    return out.select("scenario_id", F.posexplode("p").alias("place", "x")).select("scenario_id", "place", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query(seed_sql("SELECT scenario_id, ord AS place, CASE ord WHEN 0 THEN current_age ELSE m END AS s, CASE ord WHEN 0 THEN m ELSE retirement_age END AS e, CASE ord WHEN 0 THEN 5e-2 ELSE 35e-3 END AS rate, CASE WHEN ord = 1 AND ck % 2 = 0 THEN 'nominal' ELSE 'real' END AS kind FROM (SELECT *, least(retirement_age - 1, greatest(current_age + 1, current_age + 15)) AS m, unnest([0, 1]) AS ord FROM seed)"))
def normalize_phases(s: DataFrame) -> DataFrame:
    out = s.withColumn("p", state.normalize_phases(F.col("return_phases"), F.col("current_age"), F.col("retirement_age"), "return"))
    return out.select("scenario_id", F.posexplode("p").alias("place", "x")).select("scenario_id", "place", F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.rate").alias("rate"), F.col("x.kind").alias("kind"))


@query(seed_sql("SELECT k AS scenario_id, row_number() OVER (PARTITION BY k ORDER BY s, ord) - 1 AS place, id, s, months FROM (SELECT k, ord, id, s, least(months + 2e-1 + 5e-1 - (months + 2e-1 + 5e-1) % 1, 120) AS months FROM brk WHERE id <> 'b' UNION ALL SELECT k, ord, id, s, 6e0 FROM brk WHERE id = 'b')"))
def normalize_breaks(s: DataFrame) -> DataFrame:
    odd = F.transform("breaks", lambda b: b.withField("months", b["months"] + 0.2))
    out = s.withColumn("b", state.normalize_breaks(odd, F.col("current_age"), F.col("retirement_age")))
    return out.select("scenario_id", F.posexplode("b").alias("place", "x")).select("scenario_id", F.col("place").cast("long").alias("place"), F.col("x.id").alias("id"), F.col("x.start").alias("s"), F.col("x.months").alias("months"))


_RAW = "CAST(1940 + ck % 90 AS INT) AS birth_year, CASE ck % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS track, CASE ck % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'unsure' ELSE 'maybe' END AS additional_choice, current_balance - 50000 AS additional_balance, ck % 2 = 0 AS confirmed, inflation * 5 AS wild_inflation, coefficient * 2 AS wild_coefficient, CASE WHEN ck % 8 = 0 THEN NULL ELSE retirement_age END AS wild_retirement"


def _raw(s: DataFrame) -> DataFrame:
    wild = s.selectExpr("*", *[x.strip() for x in _RAW.split(", ") if " AS " in x and "CASE" not in x and "CAST" not in x], "CAST(1940 + ck % 90 AS INT) AS birth_year", "CASE ck % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS track", "CASE ck % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'unsure' ELSE 'maybe' END AS additional_choice", "CASE WHEN ck % 8 = 0 THEN NULL ELSE retirement_age END AS wild_retirement")
    return wild.withColumns({"inflation": F.col("wild_inflation"), "coefficient": F.col("wild_coefficient"), "retirement_age": F.col("wild_retirement")})


@query(seed_sql(f"""SELECT scenario_id, CAST(least({YEAR - 18}, greatest({YEAR - 70}, birth_year)) AS INT) AS birth_year, CASE WHEN track IN ('male', 'female') THEN track END AS track,
 CASE WHEN additional_choice = 'maybe' THEN 'no' ELSE additional_choice END AS additional_choice, greatest(0, additional_balance) AS additional_balance, least(1e-1, wild_inflation) AS inflation,
 least(400, greatest(100, wild_coefficient)) AS coefficient, least(80, greatest(current_age + 1, coalesce(wild_retirement, 0))) AS retirement_age, mode, confirmed FROM (SELECT *, {_RAW} FROM seed)"""))
def normalize_state(s: DataFrame) -> DataFrame:
    out = state.normalize(_raw(s), YEAR)
    return out.select("scenario_id", "birth_year", "track", "additional_choice", "additional_balance", "inflation", "coefficient", "retirement_age", "mode", "confirmed")


@query(seed_sql("SELECT scenario_id, CASE WHEN ck % 2 = 0 THEN current_balance ELSE 250000e0 END AS current_balance, 2e4 AS monthly_salary, 35e0 AS current_age, 67e0 AS retirement_age, 'percent' AS mode, 2e-2 AS inflation, 4e-2 AS return_rate, 0 AS n_breaks FROM seed"))
def hydrate_scenario(s: DataFrame) -> DataFrame:
    partial = s.select("scenario_id", F.when(F.col("ck") % 2 == 0, F.col("current_balance")).alias("current_balance"))
    out = state.hydrate(partial, YEAR)
    return out.select("scenario_id", "current_balance", "monthly_salary", "current_age", "retirement_age", "mode", "inflation", F.get("return_phases", 0)["rate"].alias("return_rate"), F.size("breaks").alias("n_breaks"))


_FEMALE = "CASE WHEN y <= 1959 THEN 62 WHEN y <= 1962 THEN 62 + (y - 1959) * 4 / 12e0 WHEN y <= 1969 THEN 63 + (y - 1962) * 25e-2 ELSE 65 END"


@query(seed_sql(f"SELECT scenario_id, y AS birth_year, {r2(f'CASE WHEN ck % 3 = 1 THEN {_FEMALE} ELSE 67 END', 'age', 6)} FROM (SELECT *, 1950 + ck % 30 AS y FROM seed)").replace("WHEN y <= 1962 THEN", "WHEN y <= 1962 THEN"))
def statutory_age(s: DataFrame) -> DataFrame:
    out = s.withColumn("birth_year", 1950 + F.col("ck") % 30).withColumn("track", F.expr("CASE ck % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END"))
    out = out.select("scenario_id", "birth_year", rates.statutory_age(F.col("birth_year"), F.col("track")).alias("age"))
    return out.select("scenario_id", "birth_year", *cents(out, "age", digits=6))


@query(seed_sql(f"SELECT scenario_id, CAST({YEAR} - y AS DOUBLE) AS current_age, {r2(f'CASE WHEN ck % 2 = 0 THEN retirement_age WHEN ck % 3 = 1 THEN {_FEMALE} ELSE 67 END', 'retirement_age', 6)}, CASE WHEN ck % 2 = 0 THEN 'user' ELSE 'system' END AS retirement_source FROM (SELECT *, least({YEAR - 18}, greatest({YEAR - 70}, 1950 + ck % 80)) AS y FROM seed)"))
def sync_default_retirement(s: DataFrame) -> DataFrame:
    raw = s.withColumns({"birth_year": 1950 + F.col("ck") % 80, "track": F.expr("CASE ck % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END"), "retirement_source": F.expr("CASE WHEN ck % 2 = 0 THEN 'user' ELSE 'payslip' END")})
    out = state.sync_retirement(raw, YEAR)
    return out.select("scenario_id", "current_age", *cents(out, "retirement_age", digits=6), "retirement_source")


@query(seed_sql(f"SELECT scenario_id, concat_ws(',', CASE WHEN y NOT BETWEEN {YEAR - 70} AND {YEAR - 18} THEN 'birth_year' END, CASE WHEN ck % 3 = 2 THEN 'track' END, CASE WHEN ck % 7 = 0 THEN 'pensionable_salary' END, CASE WHEN ck % 5 = 0 THEN 'current_balance' END, CASE WHEN ck % 2 = 0 THEN 'confirmed' END) AS errors FROM (SELECT *, 1940 + ck % 80 AS y FROM seed)"))
def validate_review(s: DataFrame) -> DataFrame:
    raw = s.withColumns({"birth_year": 1940 + F.col("ck") % 80, "track": F.expr("CASE WHEN ck % 3 < 2 THEN 'male' END"), "pensionable_salary": F.expr("CASE WHEN ck % 7 = 0 THEN 0 ELSE pensionable_salary END"), "current_balance": F.expr("CASE WHEN ck % 5 = 0 THEN NULL ELSE current_balance END"), "confirmed": F.col("ck") % 2 == 1})
    return raw.select("scenario_id", F.array_join(state.review_errors(YEAR), ",").alias("errors"))


@query(seed_sql("SELECT scenario_id, CASE WHEN ck % 2 = 0 THEN 99e0 ELSE pensionable_salary END AS pensionable_salary, CASE WHEN ck % 3 = 0 THEN 7e-2 ELSE employee_rate END AS employee_rate, current_balance FROM seed"))
def apply_extraction(s: DataFrame) -> DataFrame:
    fields = s.filter("ck % 2 = 0").select("scenario_id", F.lit("insuredSalary").alias("name"), F.lit(99.0).alias("value_num"))
    fields = fields.unionByName(s.filter("ck % 3 = 0").select("scenario_id", F.lit("employeeContributionRate").alias("name"), F.lit(0.07).alias("value_num")))
    return state.apply_extraction(s, fields).select("scenario_id", "pensionable_salary", "employee_rate", "current_balance")


@query(seed_sql("SELECT scenario_id, floor(current_balance / 10000e0 + 5e-1) * 10000e0 AS balance, floor(monthly_salary / 50e0 + 5e-1) * 50e0 AS pension FROM seed"))
def headline_rounding(s: DataFrame) -> DataFrame:
    return s.select("scenario_id", whatif.headline(F.col("current_balance"), 10000.0).alias("balance"), whatif.headline(F.col("monthly_salary"), 50.0).alias("pension"))


@query(seed_sql("SELECT scenario_id, least(5000, greatest(0, x)) AS inside, least(1, greatest(2, x)) AS crossed FROM (SELECT *, monthly_salary - 10000 AS x FROM seed)"))
def clamp(s: DataFrame) -> DataFrame:
    x = F.col("monthly_salary") - 10000
    return s.select("scenario_id", rates.clamp(x, 0, 5000).alias("inside"), rates.clamp(x, 2, 1).alias("crossed"))


_RATE = "(CAST(ck % 300 AS DOUBLE) - 150e0) / 100e0"


@query(seed_sql(f"SELECT scenario_id, {r2(f'CASE WHEN {_RATE} > -1 THEN pow(1 + {_RATE}, 1 / 12e0) - 1 END', 'monthly', 9)} FROM seed"))
def annual_to_monthly(s: DataFrame) -> DataFrame:
    out = s.select("scenario_id", rates.annual_to_monthly(F.expr(_RATE)).alias("monthly"))
    return out.select("scenario_id", *cents(out, "monthly", digits=9))


@query(seed_sql(f"SELECT scenario_id, {r2(f'(1 + {_RATE}) * (1 + inflation) - 1', 'nominal', 9)}, {r2(f'(1 + {_RATE}) / (1 + inflation) - 1', 'real', 9)} FROM seed"))
def fisher_rates(s: DataFrame) -> DataFrame:
    """real_to_nominal and nominal_to_real."""
    out = s.select("scenario_id", rates.real_to_nominal(F.expr(_RATE), F.col("inflation")).alias("nominal"), rates.nominal_to_real(F.expr(_RATE), F.col("inflation")).alias("real"))
    return out.select("scenario_id", *cents(out, "nominal", "real", digits=9))


@query(seed_sql(f"SELECT scenario_id, {r2(f'CASE WHEN ck % 2 = 0 THEN (1 + {_RATE}) * (1 + inflation) - 1 ELSE {_RATE} END', 'rate', 9)} FROM seed"))
def normalized_annual_rate(s: DataFrame) -> DataFrame:
    out = s.select("scenario_id", rates.nominal_rate(F.expr(_RATE), F.expr("CASE WHEN ck % 2 = 0 THEN 'real' ELSE 'nominal' END"), F.col("inflation")).alias("rate"))
    return out.select("scenario_id", *cents(out, "rate", digits=9))


@query(seed_sql("SELECT scenario_id, CASE WHEN ck % 3 = 0 THEN 'id-' || ck ELSE md5(CASE ck % 3 WHEN 1 THEN 'bad id ' || ck ELSE '' END || '|' || ck) END AS id FROM seed"))
def safe_id(s: DataFrame) -> DataFrame:
    raw = F.expr("CASE ck % 3 WHEN 0 THEN 'id-' || ck WHEN 1 THEN 'bad id ' || ck END")
    return s.select("scenario_id", state.safe_id(raw, F.col("ck")).alias("id"))


@query(seed_sql(f"SELECT scenario_id, abs(a - b) <= 5e-4 OR abs(a - b) <= greatest(abs(a), abs(b)) * 4e-2 AS loose, abs(a - b) <= 2 OR abs(a - b) <= greatest(abs(a), abs(b)) * 12e-3 AS tight FROM (SELECT *, monthly_salary AS a, monthly_salary * (1 + {_RATE} / 20) AS b FROM seed)"))
def approx_equal(s: DataFrame) -> DataFrame:
    a, b = F.col("monthly_salary"), F.expr(f"monthly_salary * (1 + {_RATE} / 20)")
    return s.select("scenario_id", rates.near(a, b).alias("loose"), rates.near(a, b, 2, 0.012).alias("tight"))
