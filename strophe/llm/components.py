"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.session import cut_lineage


def _hang(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them and of the node itself.

    ``edges`` are (u, v) with u > v. The large step moves larger neighbours only and looks at all
    of them; the small step moves the node and its smaller ones.
    """
    pairs = edges
    if not smaller_only:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    joined = pairs.join(least, pairs["u"] == least["c"])
    if smaller_only:
        moved = joined.select(
            F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")
        )
    else:
        moved = joined.where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")
        )
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the component's least node.

    Every round is written to the shared folder. Sums over neighbours are folded before they are
    shuffled, and the join back is one that AQE may split at a hot node. The rounds, about the
    logarithm of the longest path, go on until nothing changes.
    """
    now = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = cut_lineage(now.distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        mark = tuple(seen.first())
        if mark == before or not mark[0]:
            break
        before = mark
        now = cut_lineage(_hang(_hang(now, False), True), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
