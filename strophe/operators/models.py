"""Multivariate feature reports: components, discriminants, forests, consensus, recommendation.

Rows stay on the executors. What reaches the driver is a matrix over features or one row per
feature, method or fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions.distributed import numbered
from strophe.functions.scalars import array_sum
from strophe.operators.features import anova
from strophe.operators.forests import Forest, binned, cuts
from strophe.session import cut_lineage

#: Forests grown at a time: the last trees of one leave cores idle.
FITS_AT_ONCE = 3

# fixed values: name parts that put a feature into a category
CATEGORIES = {
    "spectral": ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff",
                 "spectral_contrast"),
    "pitch": ("f0_mean", "f0_std", "f0_min", "f0_max", "f0_range", "f0_voiced_fraction"),
    "energy": ("rms_energy", "onset_strength"),
    "temporal": ("duration_ms", "tempo_estimate", "zero_crossing_rate"),
    "context": ("prev_syllable_gap", "next_syllable_gap"),
}


def complete_rows(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    keep = df.where(F.col(label).isNotNull()) if label else df
    return keep.dropna(subset=list(features))


def _vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def group_moments(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> pd.DataFrame:
    """Count, sum and sum of outer products of the feature vectors per group.

    Every task adds its own rows up first; the groups are labels and folds.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["n long", "m array<double>"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(keys, sort=False):
                x = np.stack(part["_x"].to_numpy()).astype(np.float64)
                sums = np.concatenate([x.sum(axis=0), (x.T @ x).ravel()])
                out.append((*key, len(part), sums.tolist()))
            yield pd.DataFrame(out, columns=[*keys, "n", "m"])

    rows = df.select(*keys, _vector(features).alias("_x")).mapInPandas(partial, schema)
    summed = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("m")))).alias("m"),
    )
    return summed.toPandas()


def _split(m: Sequence[float], p: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.asarray(m, dtype=np.float64)
    return values[:p], values[p:].reshape(p, p)


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive."""
    lead = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[lead, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def _projection(features: Sequence[str], center: np.ndarray, weights: np.ndarray) -> list[Column]:
    x = F.zip_with(_vector(features), F.array(*[F.lit(float(c)) for c in center]),
                   lambda a, b: a - b)
    return [
        array_sum(F.zip_with(x, F.array(*[F.lit(float(v)) for v in weights[:, j]]),
                             lambda a, b: a * b))
        for j in range(weights.shape[1])
    ]


def pca_report(df: DataFrame, features: Sequence[str], label: str = "label",
               k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Loadings with explained shares, and the ANOVA of every component by label.

    Features are scaled with the population deviation; constant ones weigh nothing.
    """
    p, k = len(features), min(k, len(features))
    rows = complete_rows(df, features)
    moments = group_moments(rows.withColumn("_g", F.lit(1)), features, ["_g"])
    n, (s, ss) = int(moments["n"][0]), _split(moments["m"][0], p)
    mean = s / n
    cov = ss / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1][:k]
    loadings = _oriented(vectors[:, order])
    share = values[order] / values.sum()
    table = [
        (f"pc{j + 1}", features[i], float(loadings[i, j]), float(share[j]),
         float(share[: j + 1].sum()))
        for j in range(k) for i in range(p)
    ]
    loaded = df.sparkSession.createDataFrame(
        table, "component string, feature string, loading double, explained double, "
               "explained_cumulative double"
    )
    projected = rows.select(
        label,
        *[c.alias(f"pc{j + 1}")
          for j, c in enumerate(_projection(features, mean, loadings / scale[:, None]))],
    )
    return loaded, anova(projected, [f"pc{j + 1}" for j in range(k)], label)


def with_folds(rows: DataFrame, label: str, key: Column, folds: int, seed: int = 42) -> DataFrame:
    """Add ``_fold``: the rows of every label dealt out in turn, in the order of a hash of ``key``.

    A label with as many rows as there are folds is in each of them. Places are counted over bins
    of the hash, so no task orders a label.
    """
    # written first: conditions on many computed features take the optimizer minutes in a join
    hashed = cut_lineage(rows.withColumn("_key", key), "keyed")
    hashed = hashed.withColumn("_hash", F.xxhash64("_key", F.lit(seed)))
    # hashes are spread evenly, so their first 16 bits are bins of like size
    bins = F.shiftright("_hash", 48)
    placed = numbered(hashed, [label], "_hash", ["_hash", "_key"], "_place", bins)
    fold = F.pmod(F.col("_place"), F.lit(folds)).cast("int")
    return placed.withColumn("_fold", fold).drop("_key", "_hash", "_place")


def _standardized(moments: pd.DataFrame, p: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Moments of the features less their mean over the population deviation; both are returned."""
    parts = [_split(m, p) for m in moments["m"]]
    n = moments["n"].to_numpy(np.float64)
    mean = sum(s for s, _ in parts) / n.sum()
    # centred before the difference of squares is taken of the whole
    centred = [
        (s - k * mean, ss - np.outer(mean, s) - np.outer(s, mean) + k * np.outer(mean, mean))
        for k, (s, ss) in zip(n, parts, strict=True)
    ]
    scale = np.sqrt(np.maximum(np.diag(sum(ss for _, ss in centred)) / n.sum(), 0.0))
    scale[scale == 0] = 1.0
    scaled = [
        np.concatenate([s / scale, (ss / np.outer(scale, scale)).ravel()]) for s, ss in centred
    ]
    return moments.assign(m=scaled), mean, scale


class _Discriminant:
    """Linear discriminants from class moments."""

    def __init__(self, labels: list[str], n: np.ndarray, s: np.ndarray, ss: np.ndarray):
        self.labels = labels
        total = n.sum()
        means = s / n[:, None]
        grand = s.sum(axis=0) / total
        within = ss.sum(axis=0) - (n[:, None, None] * means[:, :, None] * means[:, None, :]).sum(0)
        off = means - grand
        between = (n[:, None, None] * off[:, :, None] * off[:, None, :]).sum(axis=0)
        pooled = within / max(total - len(n), 1)
        inverse = np.linalg.pinv(pooled)
        root = np.linalg.cholesky(inverse + 1e-12 * np.trace(inverse) * np.eye(len(grand)))
        values, vectors = np.linalg.eigh(root.T @ between @ root)
        k = min(len(n) - 1, len(grand))
        order = np.argsort(values)[::-1][:k]
        self.grand = grand
        self.ratio = values[order] / values[order].sum() if values[order].sum() > 0 else values[order]
        self.scalings = _oriented(root @ vectors[:, order])
        self.coef = means @ inverse
        self.intercept = -0.5 * np.einsum("kp,kp->k", self.coef, means) + np.log(n / total)


def _fit(moments: pd.DataFrame, label: str, p: int) -> _Discriminant:
    summed: dict[str, list] = {}
    for row in moments.itertuples():
        s, ss = _split(row.m, p)
        held = summed.setdefault(getattr(row, label), [0, np.zeros(p), np.zeros((p, p))])
        held[0] += row.n
        held[1] = held[1] + s
        held[2] = held[2] + ss
    labels = sorted(k for k, v in summed.items() if v[0] >= 2)
    if len(labels) < 2:
        raise ValueError("discriminants need two labels with two rows")
    return _Discriminant(
        labels,
        np.array([summed[k][0] for k in labels], dtype=float),
        np.stack([summed[k][1] for k in labels]),
        np.stack([summed[k][2] for k in labels]),
    )


def lda_report(df: DataFrame, features: Sequence[str], label: str = "label",
               key: str | Column = "id", folds: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coefficients with explained ratios, ANOVA of the discriminants, accuracy per fold.

    Features are standardised, so coefficients compare; folds are stratified by label.
    """
    p = len(features)
    key = F.col(key) if isinstance(key, str) else key
    rows = complete_rows(df, features, label).select(
        F.col(label).cast("string").alias(label), *features, key.alias("_key")
    )
    # moments, tests and hits each read the rows: their folds are found once
    rows = cut_lineage(with_folds(rows, label, F.col("_key"), folds), "folded")
    moments = group_moments(rows, features, ["_fold", label])
    moments, mean, scale = _standardized(moments, p)
    whole = _fit(moments, label, p)
    table = [
        (f"ld{j + 1}", f, float(whole.scalings[i, j]), float(whole.ratio[j]))
        for j in range(whole.scalings.shape[1]) for i, f in enumerate(features)
    ]
    spark = df.sparkSession
    coefficients = spark.createDataFrame(
        table, "discriminant string, feature string, coefficient double, explained double"
    )
    names = [f"ld{j + 1}" for j in range(whole.scalings.shape[1])]
    projected = rows.where(F.col(label).isin(whole.labels)).select(
        label, *[c.alias(n) for n, c in zip(names, _projection(
            features, mean, whole.scalings / scale[:, None]))]
    )
    models = {f: _fit(moments[moments["_fold"] != f], label, p)
              for f in sorted(moments["_fold"].unique())}

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fold, part in pdf.groupby("_fold", sort=False):
                model = models[fold]
                x = (np.stack(part["_x"].to_numpy()).astype(np.float64) - mean) / scale
                best = (x @ model.coef.T + model.intercept).argmax(axis=1)
                hit = np.asarray(model.labels)[best] == part["_y"].to_numpy()
                out.append((int(fold), len(part), int(hit.sum())))
            yield pd.DataFrame(out, columns=["fold", "n", "hits"])

    accuracy = (
        rows.select("_fold", F.col(label).alias("_y"), _vector(features).alias("_x"))
        .mapInPandas(right, "fold int, n long, hits long")
        .groupBy("fold")
        .agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"))
    )
    return coefficients, anova(projected, names, label), accuracy


def _forest_rows(df: DataFrame, features: Sequence[str], label: str, key: Column, folds: int):
    """Complete rows with number, label number and fold, written once for all fits."""
    rows = complete_rows(df, features, label)
    rows = with_folds(rows, label, key, folds) if folds > 1 else rows.withColumn("_fold", F.lit(0))
    rows = StringIndexer(inputCol=label, outputCol="_y").fit(rows).transform(rows)
    # a table of one file would be one task of every pass
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return cut_lineage(rows.select("_row", "_y", "_fold", label, *features), "forest_rows")


def _forest(trees: int, depth: int, seed: int, width: int, classes: int) -> Forest:
    """A forest whose trees are never held as a whole, neither here nor in a task."""
    return Forest(trees, depth, seed, width, classes)


def _grower(rows: DataFrame, features: Sequence[str], trees: int, depth: int, seed: int):
    """Grows a forest on the ``rows`` of all folds but one, which it judges; None: on all of them."""
    edges = cuts(rows, features)
    classes = int(rows.agg(F.max("_y")).first()[0]) + 1

    def grown(fold: int | None):
        held = F.lit(False) if fold is None else F.col("_fold") == fold
        asked = rows.select("_row", "_y", held.alias("_held"), *features)
        return _forest(trees, depth, seed, len(features), classes).fit(binned(asked, features, edges))

    return grown


def _importance_table(rows: DataFrame, model, features: Sequence[str], label: str) -> DataFrame:
    """One row per feature; the window orders as many rows as there are features."""
    weights = [(f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    table = rows.sparkSession.createDataFrame(weights, "feature string, importance double")
    w = W.partitionBy(F.lit(1)).orderBy(F.col("importance").desc(), "feature")
    upto = F.sum("importance").over(w.rowsBetween(W.unboundedPreceding, 0))
    table = table.withColumns({"cumulative": upto, "rank": F.row_number().over(w)})
    before = F.col("cumulative") - F.col("importance")
    stats = anova(rows, features, label, p_values=False).select("feature", "f_statistic")
    return table.withColumns({"needed_80": before < 0.8, "needed_90": before < 0.9}).join(
        stats, "feature", "left"
    )


def forest_importances(df: DataFrame, features: Sequence[str], label: str = "label",
                       trees: int = 100, depth: int = 30, seed: int = 42) -> DataFrame:
    """The table of :func:`forest_report` without its folds: one forest over all rows."""
    rows = _forest_rows(df, features, label, F.lit(0).cast("long"), 1)
    whole = _grower(rows, features, trees, depth, seed)(None)
    return _importance_table(rows, whole, features, label)


def forest_report(df: DataFrame, features: Sequence[str], label: str = "label",
                  key: str | Column = "id", trees: int = 100, depth: int = 30, folds: int = 5,
                  seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Importances beside F statistics with cumulative shares, and the accuracy of every fold.

    ``needed_80`` and ``needed_90`` mark the features that reach that share of all importance. A tree
    without a limit may go deeper than the default depth.
    """
    key = F.col(key) if isinstance(key, str) else key
    rows = _forest_rows(df, features, label, key, folds)
    grown = _grower(rows, features, trees, depth, seed)
    with ThreadPool(FITS_AT_ONCE) as pool:
        target = inheritable_thread_target(df.sparkSession)(grown)
        whole, *judged = pool.map(target, [None, *range(folds)], chunksize=1)
    scores = [one.accuracy for one in judged]
    return _importance_table(rows, whole, features, label), scores


def top_by(df: DataFrame, method: str, score: str, n: int = 10) -> DataFrame:
    """The first ``n`` features of one method: ``method, feature, rank, score``."""
    w = W.partitionBy(F.lit(1)).orderBy(F.col(score).desc_nulls_last(), "feature")
    ranked = df.select(
        F.lit(method).alias("method"), "feature", F.row_number().over(w).alias("rank"),
        F.col(score).cast("double").alias("score"),
    )
    return ranked.where(F.col("rank") <= n)


def consensus(tops: Sequence[DataFrame], at_least: int = 2) -> DataFrame:
    """Features that several methods put among their first."""
    pool = tops[0]
    for top in tops[1:]:
        pool = pool.unionByName(top)
    return pool.groupBy("feature").agg(F.count("*").alias("n_methods")).where(
        F.col("n_methods") >= at_least
    )


def recommend_features(agreed: DataFrame, corrected: DataFrame, high_pairs: DataFrame,
                       importance: DataFrame, max_features: int = 15) -> DataFrame:
    """Consensus features first, then significant ones, then the forest's, none redundant.

    The inputs hold one row per feature or pair of features; the choice depends on what has been
    chosen before, so it walks over them on the driver.
    """
    spark = corrected.sparkSession
    partners: dict[str, set[str]] = {}
    for a, b in high_pairs.select("feature1", "feature2").collect():
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    chosen: dict[str, tuple[str, float]] = {}
    dropped: set[str] = set()

    def walk(rows: list, reason: str, redundancy_matters: bool) -> None:
        for feature, score in rows:
            if len(chosen) >= max_features:
                return
            if feature in chosen or feature in dropped:
                continue
            if redundancy_matters and partners.get(feature, set()) & set(chosen):
                dropped.add(feature)
                continue
            chosen[feature] = (reason, float(score))

    walk(
        agreed.orderBy(F.col("n_methods").desc(), "feature")
        .select("feature", "n_methods").collect(), "consensus", False,
    )
    walk(
        corrected.where("significant_corrected")
        .orderBy(F.col("eta_squared").desc(), "feature")
        .select("feature", "eta_squared").collect(), "univariate_significant", True,
    )
    walk(
        importance.orderBy(F.col("importance").desc(), "feature")
        .select("feature", "importance").collect(), "random_forest", True,
    )
    table = []
    for rank, (feature, (reason, score)) in enumerate(chosen.items(), 1):
        category = next(
            (c for c, parts in CATEGORIES.items() if any(x in feature for x in parts)), None
        )
        redundancy = len(partners.get(feature, set()) & set(chosen))
        table.append((rank, feature, reason, score, redundancy, category))
    schema = T.StructType(
        [
            T.StructField("rank", T.IntegerType()),
            T.StructField("feature", T.StringType()),
            T.StructField("reason", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("redundancy", T.IntegerType()),
            T.StructField("category", T.StringType()),
        ]
    )
    return spark.createDataFrame(table, schema)


def compare_methods(tops: Sequence[DataFrame], accuracy: dict[str, float]) -> DataFrame:
    """One row per method: its best feature and score, how many it names, its accuracy."""
    pool = tops[0]
    for top in tops[1:]:
        pool = pool.unionByName(top)
    pairs = [x for k, v in accuracy.items() for x in (F.lit(k), F.lit(float(v)))]
    known = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    return (
        pool.groupBy("method")
        .agg(
            F.count("*").alias("n_features"),
            F.min_by("feature", "rank").alias("best_feature"),
            F.max("score").alias("best_score"),
            F.avg("score").alias("mean_score"),
        )
        .withColumn("accuracy", known[F.col("method")])
    )
