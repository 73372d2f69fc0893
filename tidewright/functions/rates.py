"""Rates, ages and tolerances as column expressions. Numbers are doubles; null stands for a missing number and counts as 0 where a rate is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

type Number = Column | float | int


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body has it."""
    return F.get(F.transform(F.array(value), body), 0)


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def number(x: Number) -> Column:
    """The finite number in a column; null, NaN and the infinities are 0."""
    x = col(x).cast("double")
    return F.when(finite(x), x).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clamp(x: Number, low: Number, high: Number) -> Column:
    """Between the bounds; where they cross, the upper one wins."""
    return F.least(col(high), F.greatest(col(low), col(x)))


def annual_to_monthly(rate: Number) -> Column:
    """The monthly rate that compounds to an annual one; null at -100 % and below."""
    rate = number(rate)
    return F.when(rate > -1, F.pow(1 + rate, F.lit(1 / 12)) - 1)


def real_to_nominal(real: Number, inflation: Number) -> Column:
    return (1 + number(real)) * (1 + number(inflation)) - 1


def nominal_to_real(nominal: Number, inflation: Number) -> Column:
    return F.try_divide(1 + number(nominal), 1 + number(inflation)) - 1


def nominal_rate(rate: Number, kind: Column, inflation: Number) -> Column:
    """An annual rate as a nominal one; kinds other than 'real' are nominal already."""
    return F.when(kind == "real", real_to_nominal(rate, inflation)).otherwise(number(rate))


def rounded(x: Number) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(col(x) + 0.5).cast("double")


def near(a: Number, b: Number, absolute: Number = 0.0005, relative: Number = 0.04) -> Column:
    """Whether two finite numbers differ by no more than either tolerance."""
    a, b = col(a), col(b)
    gap = F.abs(a - b)
    return F.coalesce(finite(a) & finite(b) & ((gap <= col(absolute)) | (gap <= F.greatest(F.abs(a), F.abs(b)) * col(relative))), F.lit(False))


#: Retirement ages of women by year of birth; 62 before, 65 after.
STATUTORY_AGES = {1960: 62 + 4 / 12, 1961: 62 + 8 / 12, 1962: 63.0, 1963: 63.25, 1964: 63.5, 1965: 63.75, 1966: 64.0, 1967: 64.25, 1968: 64.5, 1969: 64.75}


def statutory_age(birth_year: Column, track: Column) -> Column:
    """The statutory retirement age; 67 where the track is male or unknown."""
    steps = F.create_map(*[F.lit(x) for year, age in STATUTORY_AGES.items() for x in (year, age)])
    female = F.when(birth_year <= 1959, F.lit(62.0)).otherwise(F.coalesce(F.try_element_at(steps, birth_year.cast("int")), F.lit(65.0)))
    return F.when(F.coalesce(track == "female", F.lit(False)), female).otherwise(F.lit(67.0))


def pension(balance: Number, coefficient: Number, missing: float = 1.0) -> Column:
    """A monthly pension; a coefficient of 0 or null counts as `missing`, and none is below 1."""
    c = number(coefficient)
    return col(balance) / F.greatest(F.lit(1.0), F.when(c == 0, F.lit(missing)).otherwise(c))
