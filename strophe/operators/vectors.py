"""Vectors: loading, sampling, neighbours, projection and the parameter grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.distributed import beside
from strophe.operators.wide import Components, components, project
from strophe.session import cut_lineage

#: Rows of a block at least, components of its vectors at most where that allows more rows, and the
#: distances held at a time.
BLOCK_ROWS, BLOCK_CELLS, TILE_CELLS = 4096, 2**21, 2**21
#: Blocks that all rows make before blocks grow.
BLOCKS = 8


def load_vectors(df: DataFrame) -> DataFrame:
    """Add the index of every song among the songs of its subject, in name order."""
    songs = df.select("subject", "song_id").distinct()
    w = W.partitionBy("subject").orderBy("song_id")
    index = songs.withColumn("song_index", (F.row_number().over(w) - 1).cast("long"))
    return df.join(index, ["subject", "song_id"])


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that any engine with SHA-256 can repeat."""
    return F.sha2(F.concat_ws("_", key.cast("string"), F.lit(str(seed))), 256)


def subsample_rows(
    df: DataFrame, n: int, seed: int = 42, key: str = "id", by: Sequence[str] = ()
) -> DataFrame:
    """``n`` rows without replacement, of the whole table or of every group.

    ``key`` names a row within its group. Keys alone are ordered, the first ``n`` of each task or
    group; the rows themselves only meet the drawn keys.
    """
    order = hash_order(F.col(key), seed)
    if not by:
        drawn = df.select(F.col(key).alias("_key")).orderBy(hash_order(F.col("_key"), seed)).limit(n)
        return df.join(drawn, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(order))
    drawn = df.select(*by, key).withColumn("_rank", rank).where(F.col("_rank") <= n)
    names = {c: f"_by_{c}" for c in by} | {key: "_key"}
    drawn = drawn.select(*[F.col(c).alias(name) for c, name in names.items()])
    same = F.lit(True)
    for c, name in names.items():
        same = same & F.col(c).eqNullSafe(F.col(name))
    return df.join(drawn, same, "left_semi")


def subsample_by_song(
    df: DataFrame, n: int, seed: int = 42, songs_per_round: int = 10_000
) -> DataFrame:
    """Whole songs in random order while they fit into ``n`` rows, at least one per subject.

    A song that would exceed ``n`` is passed over. The walk looks at (song, size) pairs only, at
    most ``songs_per_round`` of a subject at a time, and goes on where it stopped until the sample
    is full or no song is left that fits.
    """
    sizes = df.groupBy("subject", "song_id").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("subject").agg(F.sum("n").alias("all_rows"))
    songs = cut_lineage(
        sizes.join(totals, "subject").withColumn("h", hash_order(F.col("song_id"), seed)), "songs"
    )

    def walk(acc: Column, song: Column) -> Column:
        fits = (acc["total"] == 0) | (acc["total"] + song["n"] <= n)
        take = fits & (acc["total"] < n)
        return F.struct(
            F.when(take, acc["total"] + song["n"]).otherwise(acc["total"]).alias("total"),
            F.when(take, F.array_append(acc["kept"], song["song_id"]))
            .otherwise(acc["kept"])
            .alias("kept"),
        )

    kept = songs.where(F.col("all_rows") <= n).select("subject", "song_id")
    state = totals.where(F.col("all_rows") > n).select(
        "subject", F.lit(0).cast("long").alias("total"), F.lit("").alias("seen")
    )
    first = W.partitionBy("subject").orderBy("h", "song_id")
    while True:
        ahead = songs.join(state, "subject").where(
            (F.concat("h", "song_id") > F.col("seen"))
            & ((F.col("total") == 0) | (F.col("total") + F.col("n") <= n))
        )
        ahead = ahead.withColumn("_r", F.row_number().over(first)).where(
            F.col("_r") <= songs_per_round
        )
        start = F.struct(
            F.max("total").alias("total"), F.array().cast("array<string>").alias("kept")
        )
        listed = F.array_sort(F.collect_list(F.struct("h", "song_id", "n")))
        step = cut_lineage(
            ahead.groupBy("subject").agg(
                F.aggregate(listed, start, walk).alias("w"),
                F.max(F.concat("h", "song_id")).alias("seen"),
                F.count("*").alias("looked_at"),
            ),
            "walk",
        )
        kept = kept.unionByName(step.select("subject", F.explode("w.kept").alias("song_id")))
        state = step.where(
            (F.col("looked_at") == songs_per_round) & (F.col("w.total") < n)
        ).select("subject", F.col("w.total").alias("total"), "seen")
        if state.isEmpty():
            return df.join(kept, ["subject", "song_id"], "left_semi")


def block_size(points: DataFrame) -> int:
    """Rows of a block for pairs of ``(vec)``: every row is sent once per block it meets.

    Blocks grow with the table as long as one fits a task, so that the copies of a row don't.
    """
    n, width = points.agg(F.count("*"), F.max(F.size("vec"))).first()
    return max(BLOCK_ROWS, min(n // BLOCKS, BLOCK_CELLS // max(width or 1, 1)))


def blocks(points: DataFrame, by: Sequence[str], key: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Spread the rows of every group over blocks of about ``rows`` and pair the blocks.

    Every row is sent to the block pairs it belongs to (``bi <= bj``), as member of the left block,
    of the right one, or of both. A group of n rows makes n / rows blocks, so a large group means
    more tasks, not larger ones, and no pair of rows is ever written out.
    """
    total = points.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(rows)).alias("_blocks"))
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        total = total.withColumnsRenamed({c: f"_g_{c}" for c in by})
        placed = points.join(total, same).drop(*[f"_g_{c}" for c in by])
    else:
        placed = beside(points, total)
    own = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")
    placed = placed.withColumn("_b", own)
    left = F.transform(
        F.sequence(F.col("_b"), (F.col("_blocks") - 1).cast("int")),
        lambda j: F.struct(
            F.col("_b").alias("bi"),
            j.alias("bj"),
            F.when(j == F.col("_b"), F.lit("both")).otherwise(F.lit("left")).alias("side"),
        ),
    )
    right = F.when(
        F.col("_b") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("_b") - 1),
            lambda i: F.struct(
                i.alias("bi"), F.col("_b").alias("bj"), F.lit("right").alias("side")
            ),
        ),
    )
    both = F.when(right.isNull(), left).otherwise(F.concat(left, right))
    return placed.withColumn("_p", F.explode(both)).select("*", "_p.*").drop("_p", "_blocks", "_b")


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def distance_tiles(left: np.ndarray, right: np.ndarray):
    """Euclidean distances, some rows of the left side at a time, ``TILE_CELLS`` in all.

    The squared norms go into the product of matrices, and the tile is worked on in place: passes
    over it cost as much as the product.
    """
    right = np.asarray(right, np.float64)
    wide = np.column_stack([right, np.ones(len(right)), (right * right).sum(axis=1)])
    wide = np.ascontiguousarray(wide.T)
    rows = max(1, TILE_CELLS // max(len(right), 1))
    for start in range(0, len(left), rows):
        part = np.asarray(left[start : start + rows], np.float64)
        norm = (part * part).sum(axis=1)
        tile = np.column_stack([-2 * part, norm, np.ones(len(part))]) @ wide
        np.maximum(tile, 0.0, out=tile)
        yield start, np.sqrt(tile, out=tile)


def split_sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    left = pdf[pdf["side"] != "right"]
    right = pdf[pdf["side"] != "left"]
    return left, right


def embed_pca(vecs: DataFrame, k: int = 2, scale: bool = False) -> DataFrame:
    """Project ``(id, vec)`` on its first ``k`` principal components, as ``embedding``."""
    rows = vecs.withColumn("_set", F.lit("all"))
    return project(rows, components(rows, {"all": k}, scale, by="_set"), by="_set").drop("_set")


def embed_grid(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Coordinates of every point set of ``(param_id, id, vec)`` as its parameter row asks.

    ``grid (param_id, k, scale)`` is a parameter list. Each point set has its own vectors, of any
    width; all sets of one scaling share their passes over the data. Point sets without a parameter
    row are left out.
    """
    wanted = {r["param_id"]: (r["k"], r["scale"]) for r in grid.select("param_id", "k", "scale").collect()}
    found: dict[str, Components] = {}
    for scale in (False, True):
        part = {p: k for p, (k, s) in wanted.items() if s == scale}
        if part:
            found |= components(points, part, scale)
    return project(points, found)


def param_grid(df: DataFrame, **lists: Sequence) -> DataFrame:
    """Every combination of the listed values beside every row of ``df``, with a ``param_id``."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    parts = [
        F.concat(F.lit(f"{name}="), F.regexp_replace(F.col(name).cast("string"), r"\.", "p"))
        for name in lists
    ]
    return df.withColumn("param_id", F.concat_ws("_", *parts))


def needs_recompute(existing: DataFrame, wanted: DataFrame, overwrite: bool = False) -> DataFrame:
    """Per ``param_id``: do the stored ids differ from the wanted ones?

    ``existing`` and ``wanted`` are (param_id, id), all rows of which are compared: ids are to be
    made again if there are none, or another number of them, or a wanted one is not among them.
    """
    both = (
        existing.select("param_id", "id", F.lit(1).alias("has"), F.lit(0).alias("asks"))
        .unionByName(wanted.select("param_id", "id", F.lit(0).alias("has"), F.lit(1).alias("asks")))
        .groupBy("param_id", "id")
        .agg(F.sum("has").alias("has"), F.sum("asks").alias("asks"))
    )
    sums = both.groupBy("param_id").agg(
        F.sum("asks").alias("n_wanted"),
        F.nullif(F.sum("has"), F.lit(0)).alias("n_stored"),
        F.sum(F.when(F.col("has") > 0, F.col("asks")).otherwise(0)).alias("n_shared"),
    )
    bad = (
        F.col("n_stored").isNull()
        | (F.col("n_stored") != F.col("n_wanted"))
        | (F.col("n_shared") != F.col("n_wanted"))
    )
    return sums.where("n_wanted > 0").withColumn("recompute", F.lit(True) if overwrite else bad)


def embedding_inventory(embeddings: DataFrame, params: DataFrame) -> DataFrame:
    """Rows per embedding against the rows it was made from."""
    sizes = embeddings.groupBy("param_id").agg(F.count("*").alias("n_rows"))
    return params.join(sizes, "param_id", "left").withColumns(
        {
            "n_rows": F.coalesce("n_rows", F.lit(0)),
            "subsampled": F.coalesce("n_rows", F.lit(0)) < F.col("n_original"),
        }
    )


def embedding_id(
    metric: Column, n_neighbors: Column, min_dist: Column,
    full: Column | None = None, subsample: Column | None = None, seed: Column | None = None,
) -> Column:
    """Name of an embedding from its parameters."""
    base = F.concat(metric, F.lit("_"), n_neighbors.cast("string"), F.lit("neighbors_"),
                    min_dist.cast("string"), F.lit("dist"))
    if full is not None:
        return F.concat(base, F.lit("_full"), full.cast("string"))
    if subsample is not None and seed is not None:
        return F.concat(base, F.lit("_subsample"), subsample.cast("string"), F.lit("_seed"),
                        seed.cast("string"))
    return base


EMBEDDING_ID = r"^(\w+?)_(\d+)neighbors_([0-9.]+)dist(?:_full(\d+)|_subsample(\d+)_seed(\d+))?$"


def parse_embedding_id(df: DataFrame, column: str) -> DataFrame:
    """Parameters read back from an embedding name."""
    names = {"metric": "string", "n_neighbors": "int", "min_dist": "double",
             "full": "int", "subsample": "int", "seed": "int"}
    return df.withColumns(
        {
            name: F.nullif(F.regexp_extract(column, EMBEDDING_ID, i + 1), F.lit("")).cast(kind)
            for i, (name, kind) in enumerate(names.items())
        }
    )


