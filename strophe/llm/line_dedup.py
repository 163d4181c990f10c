"""Repeated passages by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import load, text_or_empty
from strophe.session import cut_lineage

WINDOW = 3


def _window_hashes(hashes: Column, size: Column, width: int) -> Column:
    return F.when(
        size >= width,
        F.transform(
            F.sequence(F.lit(1), size - width + 1),
            lambda i: F.unhex(F.md5(F.array_join(F.slice(hashes, i, width), ""))),
        ),
    ).otherwise(F.array().cast("array<binary>"))


def repeated_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The covered line numbers (from 0) per document that has any: doc_id, digest, covered.

    ``width`` consecutive lines form a window. Of equal windows the first by (doc_id, text digest,
    position) stays, a null doc_id coming last; the lines of all later ones are covered. Rows that
    agree in doc_id and text are one document. Texts of fewer lines have no window.

    A window is an MD5 of line hashes. Windows are folded per task before the shuffle; the join of
    windows with the repeated ones moves narrow rows, and AQE may split a hot one.
    """
    lines = F.split(text_or_empty(), "\n")
    hashed = docs.select(
        "doc_id",
        F.unhex(F.md5(text_or_empty())).alias("digest"),
        F.transform(lines, lambda line: F.md5(line)).alias("lines"),
    )
    windows = cut_lineage(
        hashed.select(
            "doc_id",
            "digest",
            F.posexplode(_window_hashes(F.col("lines"), F.size("lines"), width)).alias("pos", "w"),
        ).select(
            F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("doc"),
            "pos",
            "w",
        ),
        "windows",
    )
    place = F.struct("doc", "pos")
    repeated = cut_lineage(
        windows.groupBy("w")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1"),
        "repeated",
    )
    later = windows.join(repeated, "w").where(place != F.col("first"))
    return (
        later.select("doc", F.explode(F.sequence("pos", F.col("pos") + (width - 1))).alias("line"))
        .groupBy("doc")
        .agg(F.collect_set("line").alias("covered"))
        .select("doc.doc_id", "doc.digest", "covered")
    )


def drop_repeated_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with the later occurrences of repeated windows cut out of ``text``.

    Adds n_lines and n_removed, in place of columns of these names. Null text is empty: one empty
    line. All other columns stay.
    """
    covered = repeated_lines(docs.select("doc_id", "text"), width).select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"),
        F.col("covered").alias("__covered"),
    )
    named = docs.withColumn("__own", F.unhex(F.md5(text_or_empty())))
    joined = named.join(
        covered,
        named["doc_id"].eqNullSafe(covered["__id"]) & (named["__own"] == covered["__digest"]),
        "left",
    )
    lines = F.split(text_or_empty(), "\n")
    # a map answers at once; a scan of the covered lines for each line would be quadratic
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__covered")),
        lambda i: F.get(lines, i),
    )
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.select(
        *columns,
        F.size(lines).alias("n_lines"),
        F.coalesce(F.size("__covered"), F.lit(0)).alias("__removed"),
        F.when(F.col("__covered").isNull(), text_or_empty())
        .otherwise(F.array_join(kept, "\n"))
        .alias("text"),
    ).withColumn("n_removed", F.greatest("__removed", F.lit(0))).drop("__removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id",
        F.col("n_lines").cast("long"),
        F.col("n_removed").cast("long"),
        F.sha2("text", 256).alias("text_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)
),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM w
  ) WHERE nth > 1
),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n
  FROM lines ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines,
       CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS text_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
