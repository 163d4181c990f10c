"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a longest run of characters other than space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; nothing else is read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. Pure ASCII takes the fast built-in, which then agrees."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def row_hash(columns: list[str]) -> Column:
    """A number made from the named columns, whatever their type: maps can't be ordered or hashed."""
    return F.xxhash64(F.to_json(F.struct(*columns))) if columns else F.lit(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def cut_points(df: DataFrame, value: str, parts: int) -> list:
    """At most ``parts - 1`` ascending values that cut ``df`` into parts of like row counts.

    The only thing the driver gets is this list. Rows that share one value stay together, so
    ``value`` should be distinct enough.
    """
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(value, shares, 20 * parts).alias("p")).first()["p"]
    return sorted(set(found or []))


def part_of(value: Column, cuts: list) -> Column:
    """The number of cuts that are not above ``value``; null comes first.

    A balanced tree of comparisons: as many steps as the logarithm of the number of cuts.
    """

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(value.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def running_start(df: DataFrame, keys: list[str], bucket: str, order: list, size: str, name: str):
    """Add ``name``: the sum of ``size`` over the rows before, per ``keys``, by (bucket, order).

    Windows sort one bucket only; bucket totals, one narrow row each, carry the sums across.
    ``bucket`` must be finer than any hot key.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = df.groupBy(*keys, bucket).agg(F.sum(size).alias("__total"))
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("__bucket"),
        F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__base"),
    )
    own = df.withColumn("__in", F.sum(size).over(inner) - F.col(size))
    match = F.col(bucket) == F.col("__bucket")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return own.join(base, match).withColumn(name, F.col("__in") + F.col("__base")).select(
        *df.columns, name
    )
