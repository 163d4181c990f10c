"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero, so equal values compare equal."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def round_all(df, names: Sequence[str], digits: int = 6):
    return df.withColumns({name: rounded(name, digits) for name in names})


def plogp(p: Column) -> Column:
    """-p ln p with 0 ln 0 = 0."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def ratio(num, den) -> Column:
    """num / den as double, null where the denominator is zero."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num.cast("double"), den.cast("double"))
