"""Upper tail of the F distribution."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float, y: float) -> float:
    """The continued fraction of Didonato and Morris for I_x(a, b), by Lentz's method.

    Its terms hold a * y - b * x and no difference of nearly equal numbers, so it keeps its digits
    for any a and b. It takes about the square root of the larger one in steps and goes on until
    it has converged; ``ArithmeticError`` where rounding keeps it from that.
    """
    lead = a * y - b * x + 1.0
    out = c = a * lead / (a + 1.0) or _TINY
    d = 0.0
    enough = 1000 + 100 * math.sqrt(max(a, b))
    for m in itertools.count(1):
        odd = a + 2 * m - 1
        over = (a + m - 1) / odd * ((a + b + m - 1) / odd) * m * (b - m) * x * x
        under = m + m * (b - m) * x / odd + (a + m) * (lead + m * (1.0 + y)) / (odd + 2)
        d = 1.0 / (under + over * d or _TINY)
        c = under + over / c or _TINY
        out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return 1.0 / out
        if m > enough:
            raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def _stirling_rest(z: float) -> float:
    """lgamma(z) less Stirling's leading terms."""
    if z < 10.0:
        return math.lgamma(z) - (z - 0.5) * math.log(z) + z - 0.5 * math.log(2.0 * math.pi)
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z


def _beta_front(a: float, b: float, x: float, y: float) -> float:
    """x**a * y**b / B(a, b), y being 1 - x, without differences of large logarithms."""
    apart = x * b - y * a
    logs = 0.0
    for size, share, step in ((a, x * (a + b) / a, apart / a), (b, y * (a + b) / b, -apart / b)):
        if share <= 0.0:
            return 0.0
        logs += size * (math.log1p(step) if 0.5 < share < 2.0 else math.log(share))
    logs += _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b)
    return math.sqrt(a / (2.0 * math.pi) * (b / (a + b))) * math.exp(logs)


def incomplete_beta(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); ``y`` is 1 - x where it is known better."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    front = _beta_front(a, b, x, y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x, y)
    return 1.0 - front * _beta_fraction(b, a, y, x)


def f_tail_value(f: float, d1: float, d2: float) -> float:
    if not (f == f and d1 > 0 and d2 > 0):
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    total = d2 + d1 * f
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / total, d1 * f / total)


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F > f) with d1 and d2 degrees of freedom; runs on one row per tested feature."""
    return pd.Series(
        [f_tail_value(a, b, c) for a, b, c in zip(f, d1, d2)], index=f.index, dtype="float64"
    )
