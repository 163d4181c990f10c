"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import ascii_lower, load, row_hash, text_or_empty
from strophe.session import cut_lineage

#: A chunk ends after 1,024 characters at the next line end or sentence end, or after 8,192.
CHUNK = r"(?s).{1024,8192}?(?:\n|[.!?] |\z)|.{8192}|.+"

#: Identifiers are tried in this order until no two chunk contents share one.
IDENTIFIERS = (
    lambda chunk: F.xxhash64(chunk),
    lambda chunk: F.unhex(F.sha2(chunk, 256)),
)


def chunks(text: Column) -> Column:
    """Cut a text where its own content says so; the chunks in order give the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _verified(docs: DataFrame) -> int:
    """Which identifier tells all chunk contents of ``docs`` apart.

    Every content is moved once, after its repeats inside a task are folded, and is compared as a
    grouping key, so an identifier with two contents shows as two rows.
    """
    for which, identify in enumerate(IDENTIFIERS):
        distinct = (
            docs.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
            .select(identify(F.col("chunk")).alias("id"), "chunk")
            .distinct()
        )
        if distinct.groupBy("id").count().where("count > 1").isEmpty():
            return which
    raise ValueError("two chunk contents share a SHA-256")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): group, surviving row and digest.

    Texts are equal when they are identical after lower-casing A to Z; null counts as empty. Of
    equal texts the row with the largest doc_id stays; a null doc_id stays only if its group has
    no other. Of rows that agree in doc_id too, one is kept. Other columns are ignored. An empty
    table gives an empty table.

    A text becomes an ordered list of chunk identifiers, and only these lists are grouped and
    joined. They are folded by (list, doc_id) and by list before a shuffle, so a large group costs
    one row per task; in the join back AQE may split it, as both sides are plain exchanges.
    """
    norm = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", ascii_lower(F.col("text")).alias("norm")
    )
    identify = IDENTIFIERS[_verified(norm)]
    recipes = norm.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), identify).alias("recipe"),
    )
    rows = cut_lineage(
        recipes.groupBy("recipe", "doc_id", "text_sha256").agg(F.count("*").alias("n")), "recipes"
    )
    groups = cut_lineage(
        rows.groupBy("recipe").agg(
            F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")
        ),
        "groups",
    )
    return rows.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
        "text_sha256",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that agree in doc_id and text, the one with the smallest hash of the other columns
    stays; these may have any type.
    """
    stay = exact_groups(docs).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")
    )
    named = docs.withColumn("__own_sha", F.sha2(ascii_lower(text_or_empty()), 256))
    found = named.join(
        stay,
        named["doc_id"].eqNullSafe(stay["__id"]) & (named["__own_sha"] == stay["__sha"]),
        "left_semi",
    )
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    window = Window.partitionBy("doc_id", "__own_sha").orderBy(row_hash(others), "text")
    return found.withColumn("__nth", F.row_number().over(window)).where("__nth = 1").select(
        *docs.columns
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
