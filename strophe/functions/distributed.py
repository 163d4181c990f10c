"""Order statistics that stay exact when one group holds most of the rows.

The values of a group are cut at its approximate quantiles, and every such bin again into equal
widths, so neither outliers nor a large group put many values into one bin; equal values are counted,
not repeated. Only bin totals are ordered per group. The quantiles decide where to cut and nothing
else: results are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.scalars import ratio
from strophe.session import cut_lineage

#: Cuts per group, a power of two, and equal widths between two of them.
CUTS, WIDTHS = 256, 64
#: The bin of null values, past all others.
NULL_BIN = CUTS * WIDTHS + WIDTHS


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table beside every row, as a scalar subquery and not as a join."""
    row = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def with_totals(df: DataFrame, by: Sequence[str], **aggs) -> DataFrame:
    """Add aggregates of the group to every row without ordering or collecting the group."""
    columns = [expr.alias(name) for name, expr in aggs.items()]
    if by:
        return df.join(df.groupBy(*by).agg(*columns), list(by))
    return beside(df, df.agg(*columns))


def _edges(value: Column) -> Column:
    """Ascending approximate quantiles of a group, from a sketch that tasks merge."""
    shares = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    return F.percentile_approx(value, shares, 2 * CUTS)


def with_bin(df: DataFrame, by: Sequence[str], number: Column) -> DataFrame:
    """Add ``_bin``, which never falls when ``number`` grows. Nulls get the bin past the last.

    ``df`` is read twice, so it should be a written table. The edges are written as well: their size
    is then known, and rows of few groups are neither shuffled by group nor left to as many tasks.
    Every step of the search is a column of its own, which one expression would repeat.
    """
    if by:
        edges = df.groupBy(*by).agg(_edges(number).alias("_edges"))
        out = df.join(cut_lineage(edges, "edges"), list(by))
    else:
        out = beside(df, df.agg(_edges(number).alias("_edges")))
    out = out.withColumn("_cut", F.lit(0))
    steps = [CUTS >> i for i in range(1, CUTS.bit_length())]
    for step in [*steps, 1]:
        passed = F.get("_edges", F.col("_cut") + F.lit(step - 1)) <= number
        out = out.withColumn("_cut", F.col("_cut") + F.when(passed, step).otherwise(0))
    low, high = F.get("_edges", F.col("_cut") - 1), F.get("_edges", F.col("_cut"))
    share = F.floor(ratio(number - low, high - low) * WIDTHS)
    width = F.when(F.isnan(share.cast("double")), 0).otherwise(F.coalesce(share, F.lit(0)))
    width = F.least(F.greatest(width, F.lit(0)), F.lit(WIDTHS - 1))
    found = (F.col("_cut") * WIDTHS + width).cast("int")
    return out.withColumn("_bin", F.when(number.isNull(), NULL_BIN).otherwise(found)).drop(
        "_edges", "_cut"
    )


def value_counts(
    df: DataFrame, by: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Distinct values ``_v`` of every group and how often each occurs, written: ``df`` is read once."""
    times = F.count("*") if weight is None else F.sum(weight)
    counts = df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(times.alias("_n"))
    return cut_lineage(counts, "counts")


def _binned(
    df: DataFrame, by: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Counts of distinct values, with the bin of each. Null values get the bin past the last."""
    return with_bin(value_counts(df, by, value, weight), by, F.col("_v"))


def _with_before(counts: DataFrame, by: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``_before``: how many rows of the group come before the value."""
    bins = counts.groupBy(*by, "_bin").agg(F.sum("_n").alias("_bin_n"))
    is_null = (F.col("_bin") == NULL_BIN).cast("int")
    order = [is_null, F.col("_bin").desc() if descending else F.col("_bin").asc()]
    earlier = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(
        *by, "_bin", F.coalesce(F.sum("_bin_n").over(earlier), F.lit(0)).alias("_offset")
    )
    return _inside(counts.join(bins, [*by, "_bin"]), by, descending)


def _inside(counts: DataFrame, by: Sequence[str], descending: bool = False) -> DataFrame:
    """``_before`` of values whose bin starts at ``_offset``."""
    inside = (
        W.partitionBy(*by, "_bin")
        .orderBy(F.col("_v").desc() if descending else F.col("_v").asc())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    before = F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return counts.withColumn("_before", before).drop("_offset", "_bin")


def average_rank(
    df: DataFrame, value: str, name: str, by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Add the average rank of ``value`` in its group, ties sharing theirs, nulls last."""
    by = list(by)
    ranks = _with_before(_binned(df, by, value), by, descending).select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_v").alias("_value"),
        (F.col("_before") + (F.col("_n") + 1) / 2).alias(name),
    )
    same = F.col(value).cast("double").eqNullSafe(F.col("_value"))
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return df.join(ranks, same, "left").drop("_value", *[f"_{c}" for c in by])


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Interpolated quantiles of every group, one column per entry of ``quantiles``.

    ``weight`` is how often a row counts; 1 without it. Only values of bins that hold an asked rank
    are ordered.
    """
    by = list(by)
    counts = _binned(df.where(F.col(value).isNotNull()), by, value, weight)
    bins = counts.groupBy(*by, "_bin").agg(F.sum("_n").alias("_bin_n"))
    asked = quantile_bins(bins, by, quantiles)
    return quantiles_within(counts.join(asked, [*by, "_bin"]), by, quantiles)


def quantile_bins(bins: DataFrame, by: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Of bins with ``_bin_n`` rows those that hold a rank of ``quantiles``, written.

    ``_offset`` rows of the group's ``_total`` come before a bin.
    """
    upto = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    everything = F.sum("_bin_n").over(
        W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    placed = bins.withColumns(
        {"_offset": F.sum("_bin_n").over(upto) - F.col("_bin_n"), "_total": everything}
    )
    last = F.col("_offset") + F.col("_bin_n") - 1
    holds = F.lit(False)
    for q in quantiles.values():
        spot = (F.col("_total") - 1) * F.lit(float(q))
        for rank in (F.floor(spot), F.ceil(spot)):
            holds = holds | ((F.col("_offset") <= rank) & (rank <= last))
    return cut_lineage(placed.where(holds).drop("_bin_n"), "asked_bins")


def quantiles_within(
    counts: DataFrame, by: Sequence[str], quantiles: dict[str, float]
) -> DataFrame:
    """Quantiles from the values of the bins of :func:`quantile_bins`, as often as ``_n``."""
    placed = _inside(counts, by)
    last = F.col("_before") + F.col("_n") - 1

    def at(rank):
        return F.max(F.when((F.col("_before") <= rank) & (rank <= last), F.col("_v")))

    columns = []
    for name, q in quantiles.items():
        spot = (F.col("_total") - 1) * F.lit(float(q))
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        part = F.max(spot - F.floor(spot))
        columns.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*by).agg(*columns) if by else placed.agg(*columns)


def numbered(
    df: DataFrame, by: Sequence[str], key: str, order: Sequence, name: str,
    bins: Column | None = None,
) -> DataFrame:
    """Add the 0-based place of every row in its group, without ordering a group in one task.

    Rows are binned by the numeric ``key`` (null keys last) and ordered by ``order``, of which
    ``key`` must be the first part, inside a bin. Rows that share one key share a bin. ``bins``, a
    whole number that never falls when ``key`` grows, spares the look for edges; ``df`` is then read
    twice and should be a written table.
    """
    by = list(by)
    if bins is None:
        binned = with_bin(cut_lineage(df, "binned"), by, F.col(key).cast("double"))
    else:
        binned = df.withColumn("_bin", bins)
    totals = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(W.partitionBy(*by, "_bin").orderBy(*order)) - 1
    return (
        binned.withColumn("_r", inside)
        .join(totals, [*by, "_bin"])
        .withColumn(name, F.col("_start") + F.col("_r"))
        .drop("_bin", "_r", "_start")
    )
