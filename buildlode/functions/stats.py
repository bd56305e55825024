"""Upper tail of the chi-square distribution as a native column expression.

With whole degrees of freedom the tail is a finite sum of positive terms, each kept as a
logarithm so that none overflows: for an even number the sum alone, for an odd number the
tail of one degree before it, by its power series near zero and its continued fraction
beyond. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series below SPLIT and of the fraction from there on; more change no digit.
SERIES, FRACTION, SPLIT = 60, 100, 1.5


def chi2_tail_sql(statistic: str, dof: str) -> str:
    """P(X >= statistic) for chi-square X; 1 where there are no degrees of freedom."""
    x = f"({statistic} / 2.0D)"
    half = f"(({dof} % 2) / 2.0D)"  # exponents are whole for an even number, else half
    # Exponents half, half + 1, ...: the first term's logarithm, then ln x - ln(exponent) more each.
    count = f"cast(({dof} - {dof} % 2) / 2 AS int)"
    first = f"(-{x} + CASE WHEN {dof} % 2 = 0 THEN 0.0D ELSE 0.5D * ln({x}) - ln(sqrt(pi()) / 2.0D) END)"
    rest = f"CASE WHEN {count} > 1 THEN sequence(1, {count} - 1) ELSE array() END"
    step = f"acc.log + ln({x}) - ln(k + {half})"
    sums = f"""aggregate({rest}, named_struct('sum', exp({first}), 'log', {first}),
        (acc, k) -> named_struct('sum', acc.sum + exp({step}), 'log', {step}), acc -> acc.sum)"""
    series = f"""aggregate(sequence(1, {SERIES}), named_struct('sum', 1.0D, 'term', 1.0D),
        (acc, k) -> named_struct('sum', acc.sum + acc.term * {x} / (k + 0.5D), 'term', acc.term * {x} / (k + 0.5D)), acc -> acc.sum)"""
    fraction = f"aggregate(sequence({FRACTION}, 1, -1), {x} + {2 * FRACTION + 0.5}D, (f, k) -> {x} + 2 * k - 1.5D - k * (k - 0.5D) / f)"
    scale = f"exp(-{x}) * sqrt({x} / pi())"
    one = f"CASE WHEN {x} < {SPLIT}D THEN 1.0D - 2.0D * {scale} * {series} ELSE {scale} / ({fraction}) END"
    tail = f"CASE WHEN {count} > 0 THEN {sums} ELSE 0.0D END + CASE WHEN {dof} % 2 = 1 THEN {one} ELSE 0.0D END"
    return f"CASE WHEN {dof} > 0 AND {statistic} > 0 THEN least(1.0D, greatest(0.0D, {tail})) ELSE 1.0D END"


def chi2_p_value(statistic: str, dof: str) -> Column:
    """The tail of two columns, a double and an int."""
    return F.expr(chi2_tail_sql(statistic, dof))
