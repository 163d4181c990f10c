"""Exact top-k by inner product as a Voronoi join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import load
from strophe.session import cut_lineage

#: Rows of a data block and queries of a query group, about.
BLOCK = 4096
GROUP = 1024

PLACED = "vec_id long, v array<long>, cell int, distance double, norm double"
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def valid(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(column, width: int) -> np.ndarray:
    """Lists as rows; shorter ones are filled with zeros, which add nothing to a product."""
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    return out


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where all sums fit them, else in integers."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0))
    if largest * max(1, data.shape[1]) < 2**53:
        return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    return queries @ data.T


def _place(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot, the distance to it and the length of the vector."""
    width = pivots.shape[1]
    squares = (pivots**2).sum(axis=1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), width).astype(np.float64)
            own = (x**2).sum(axis=1)
            cell = np.argmin(squares - 2 * (x @ pivots.T), axis=1)
            distance = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("v"),
                    pa.array(cell.astype(np.int32)),
                    pa.array(distance),
                    pa.array(np.sqrt(own)),
                ],
                names=["vec_id", "v", "cell", "distance", "norm"],
            )

    return vectors.mapInArrow(place, PLACED)


def _query_groups(counts: dict[int, int], pivots: np.ndarray, group: int):
    """Cell to (first group, groups): neighbouring small cells share one, large ones are split."""
    direction = np.random.default_rng(3).standard_normal(pivots.shape[1])
    first, parts = {}, {}
    at, filled = 0, 0
    for cell in sorted(counts, key=lambda c: float(pivots[c] @ direction)):
        n = counts[cell]
        if filled and filled + n > group:
            at, filled = at + 1, 0
        first[cell], parts[cell] = at, max(1, math.ceil(n / group))
        if parts[cell] > 1:
            at, filled = at + parts[cell], 0
        else:
            filled += n
    return first, parts


def _solve(queries: DataFrame, data: DataFrame, k: int, width: int) -> DataFrame:
    """The k best of every (query group, data block) for each query that was sent there."""
    keys = ["grp", "cell", "part"]
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return empty
        scores = _products(_matrix(left["v"], width), _matrix(right["v"], width))
        ids, asked = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        out = []
        for q, row in zip(asked, scores, strict=True):
            others = np.flatnonzero(ids != q)
            own = row[others]
            if len(own) > k:
                least = np.partition(own, len(own) - k)[len(own) - k]
                others = others[own >= least]
            order = np.lexsort((ids[others], -row[others]))[:k]
            out.append(
                pd.DataFrame(
                    {"query_id": q, "vec_id": ids[others][order], "score": row[others][order]}
                )
            )
        return pd.concat(out) if out else empty

    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(best, FOUND)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """The k highest integer inner products of every query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; other columns are ignored. Null ids, null vectors and
    vectors that hold null, NaN or infinite components take no part. Shorter vectors count as
    filled with zeros. A query is not its own candidate, which goes by id; of repeated query ids
    the smallest vector asks; repeated candidates each count. Ties go to the smaller vec_id.
    Without queries or candidates the result is empty.

    Pivots, about sqrt(n) / 4 rows by hash, divide all vectors into cells. Of every cell the
    driver keeps size, radius and largest length. Queries are grouped by cell. Each query is first
    solved in the cell whose pivot fits it best; its k-th score there excludes every cell whose
    bound, query * pivot + |query| * radius or |query| * largest length, lies below. Only data of
    cells that some query of a group still needs is sent to that group, in blocks of about
    ``block`` rows, so neither a large cell nor a query-rich one meets in one task.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(
        "vec_id", quantised(F.col("embedding")).alias("v")
    )
    n = usable.count()
    width = usable.agg(F.max(F.size("v"))).first()[0]
    if not n or not width:
        placed = usable.select("vec_id", "v", F.lit(0).alias("cell"))
        pivots = np.zeros((1, max(1, width or 0)))
    else:
        chosen = (
            usable.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(math.ceil(math.sqrt(n) / 4))
        )
        pivots = _matrix([r["v"] for r in chosen.select("v").collect()], width).astype(np.float64)
        placed = _place(usable, pivots)
    width = pivots.shape[1]
    if n and "norm" not in placed.columns:  # only empty vectors: all products are 0
        placed = placed.withColumns({"distance": F.lit(0.0), "norm": F.lit(0.0)})
    if not n:
        return usable.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score long"
        )
    placed = cut_lineage(placed, "placed")

    cells = placed.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.max("distance").alias("radius"),
        F.max("norm").alias("norm"),
        F.count(F.when(is_query, 1)).alias("queries"),
    ).collect()
    size, radius, longest = (np.zeros(len(pivots)) for _ in range(3))
    radius -= np.inf
    for row in cells:
        size[row["cell"]], radius[row["cell"]] = row["n"], row["radius"]
        longest[row["cell"]] = row["norm"]
    counts = {r["cell"]: r["queries"] for r in cells if r["queries"]}
    first, parts = _query_groups(counts, pivots, group)
    blocks = {r["cell"]: max(1, math.ceil(r["n"] / block)) for r in cells}

    def lookup(values: dict[int, int]) -> Column:
        return F.element_at(
            F.array(*[F.lit(values.get(c, 0)) for c in range(len(pivots))]), F.col("cell") + 1
        )

    hashed = F.xxhash64("vec_id", "v")
    data = placed.select(
        "vec_id",
        "v",
        "cell",
        F.pmod(hashed, lookup(blocks)).cast("int").alias("part"),
    )
    queries = (
        placed.where(is_query)
        .groupBy("vec_id")
        .agg(F.min(F.struct("v", "cell", "norm")).alias("q"))
        .select("vec_id", "q.*")
        .withColumn(
            "grp",
            (lookup(first) + F.pmod(hashed, F.greatest(lookup(parts), F.lit(1)))).cast("int"),
        )
        .select("vec_id", "v", "norm", "grp")
    )
    queries = cut_lineage(queries, "queries")

    def needed(after: bool):
        """The best cell of a query, or all others that may hold one of its k best."""

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column("v").to_pylist(), width).astype(np.float64)
                norm = batch.column("norm").to_numpy()[:, None]
                products = q @ pivots.T
                best = np.argmax(np.where(size > 0, products, -np.inf), axis=1)
                if after:
                    bound = np.minimum(products + norm * radius, norm * longest)
                    slack = 1e-9 * (np.abs(products) + norm * np.maximum(longest, 1)) + 1e-6
                    least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)
                    wanted = (bound + slack >= least[:, None]) & (size > 0)
                    wanted[np.arange(len(q)), best] = False
                else:
                    wanted = np.zeros(products.shape, bool)
                    wanted[np.arange(len(q)), best] = True
                row, cell = np.nonzero(wanted)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(rows),
                        batch.column("v").take(rows),
                        batch.column("grp").take(rows),
                        pa.array(cell.astype(np.int32)),
                    ],
                    names=["vec_id", "v", "grp", "cell"],
                )

        return pick

    def solve(asking: DataFrame, after: bool) -> DataFrame:
        sent = cut_lineage(
            asking.mapInArrow(needed(after), "vec_id long, v array<long>, grp int, cell int"),
            "sent",
        )
        # aliases: the two sides of a cogroup must not share attributes
        pairs = sent.select(F.col("grp").alias("grp"), F.col("cell").alias("cell")).distinct()
        replicated = data.join(pairs, "cell")
        spread = sent.withColumn(
            "part", F.explode(F.sequence(F.lit(0), lookup(blocks) - 1))
        )
        return _solve(spread, replicated, k, width)

    start = cut_lineage(solve(queries, False), "start")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (
        start.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") == k)
        .select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    )
    # without k results so far, every cell is needed
    asking = queries.join(kth, "vec_id", "left").withColumn(
        "least", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
    )
    return (
        start.unionByName(solve(asking, True))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 5
"""
