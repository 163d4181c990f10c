"""The segment feature table and statistics of features against labels.

Features are columns. Moments of all features are taken in one aggregation per label and only then
turned into one row per feature, so no row of the table is repeated per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions.distributed import (
    beside,
    exact_quantiles,
    numbered,
    quantile_bins,
    quantiles_within,
    value_counts,
    with_bin,
    with_totals,
)
from strophe.functions.scalars import ratio
from strophe.functions.tails import f_tail
from strophe.operators.scores import ari, nmi
from strophe.operators.vectors import blocks, hash_order, split_sides
from strophe.operators.wide import correlations  # noqa: F401 - one of the feature reports
from strophe.params import NOISE
from strophe.session import cut_lineage

# fixed values: effect sizes from which a share of variance counts as large, medium, small
EFFECT_BANDS = ((0.14, "large"), (0.06, "medium"), (0.01, "small"))


def build_feature_db(
    segs: DataFrame, features: DataFrame, labels: DataFrame, methods: Sequence[str],
    wide: bool = True,
) -> DataFrame:
    """Segments with their features and every label set, -1 where a set does not know a segment.

    ``labels (segment_id, method, label int)``. Wide form has ``cluster_<method>`` columns, the
    other a ``labels`` map.
    """
    chosen = labels.groupBy("segment_id").agg(
        *[F.max(F.when(F.col("method") == m, F.col("label"))).alias(f"cluster_{m}")
          for m in methods]
    )
    out = segs.join(features, "segment_id", "left").join(chosen, "segment_id", "left")
    out = out.withColumns(
        {f"cluster_{m}": F.coalesce(f"cluster_{m}", F.lit(-1)) for m in methods}
    )
    if wide:
        return out
    pairs = [x for m in methods for x in (F.lit(m), F.col(f"cluster_{m}"))]
    return out.withColumn("labels", F.create_map(*pairs)).drop(*[f"cluster_{m}" for m in methods])


def expand_label_map(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """A JSON object of labels turned into one integer column per key."""
    parsed = F.from_json(column, "map<string,int>")
    return df.withColumn("_map", parsed).withColumns(
        {f"cluster_{k}": F.col("_map")[k] for k in keys}
    ).drop("_map")


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Scalar numeric columns, identifiers and cluster columns left out."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in exclude
        and not f.name.startswith("cluster_")
    ]


def unpivot(df: DataFrame, keep: Sequence[str], names: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """One row per column of ``names``."""
    cells = F.array(
        *[F.struct(F.lit(n).alias(name), F.col(n).cast("double").alias(value)) for n in names]
    )
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def feature_coverage(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Non-null count and share per feature."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count(f).alias(f) for f in features]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).alias("present"),
                ratio(f, "n").alias("coverage"),
            )
            for f in features
        ]
    )
    return counts.select(*by, "n", F.explode(cells).alias("_c")).select(*by, "n", "_c.*")


def db_summary(df: DataFrame, by: Sequence[str] = ("subject",), song: str = "song_id",
               duration: str = "duration", label: str = "label") -> DataFrame:
    """Totals, songs, duration spread and label coverage per group."""
    by = list(by)
    songs = df.groupBy(*by, song).agg(F.lit(1).alias("_s")).groupBy(*by).agg(
        F.count("*").alias("n_songs")
    )
    labels = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.lit(1).alias("_l"))
    labels = labels.groupBy(*by).agg(F.count("*").alias("n_labels"))
    stats = df.groupBy(*by).agg(
        F.count("*").alias("n_segments"),
        F.count(label).alias("n_labelled"),
        F.avg(duration).alias("duration_mean"),
        F.stddev_samp(duration).alias("duration_std"),
        F.min(duration).alias("duration_min"),
        F.max(duration).alias("duration_max"),
    )
    medians = exact_quantiles(df, duration, {"duration_median": 0.5}, by)
    return (
        stats.join(songs, by).join(labels, by, "left").join(medians, by, "left")
        .withColumns(
            {
                "n_labels": F.coalesce("n_labels", F.lit(0)),
                "label_coverage": ratio("n_labelled", "n_segments"),
            }
        )
    )


def summary_by_label(df: DataFrame, feature: str, label: str = "label",
                     by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Count, mean, deviation, range and median of one feature per label."""
    keys = [*by, label]
    rows = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.avg(feature).alias("mean"),
        F.stddev_samp(feature).alias("std"),
        F.min(feature).alias("min"),
        F.max(feature).alias("max"),
    )
    out = stats.join(exact_quantiles(rows, feature, {"median": 0.5}, keys), keys)
    return out.withColumns(
        {c: F.round(F.col(c).cast("double"), digits) for c in ("mean", "std", "min", "max", "median")}
    )


def label_timing_stats(df: DataFrame, label_columns: Sequence[str],
                       measures: Sequence[str] = ("duration", "prev_gap", "next_gap"),
                       by: Sequence[str] = ()) -> DataFrame:
    """Mean of the timing columns per label of every label set."""
    sets = F.array(
        *[F.struct(F.lit(c).alias("label_set"), F.col(c).cast("string").alias("label"))
          for c in label_columns]
    )
    long = df.select(*by, *measures, F.explode(sets).alias("_l")).select(*by, *measures, "_l.*")
    return long.where(F.col("label").isNotNull()).groupBy(*by, "label_set", "label").agg(
        F.count("*").alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in measures]
    )


def label_moments(df: DataFrame, features: Sequence[str], label: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Per feature and label: n, mean, sum of squares around the mean, smallest, largest."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                (F.var_pop(x) * F.count(x)).alias("ss"),
            ).alias(f)
        )
    wide = df.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("label")).agg(*aggs)
    return (
        wide.select(*by, "label", F.explode(F.array(*features)).alias("_m"))
        .select(*by, "label", "_m.*")
        .where(F.col("n") > 0)
    )


def array_moments(df: DataFrame, column: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """:func:`label_moments` of every element of an array column, named ``<column>_<i>``."""
    long = df.where(F.col(label).isNotNull()).select(
        *by, F.col(label).alias("label"), F.posexplode(column).alias("_i", "_x")
    )
    x = F.col("_x").cast("double")
    return (
        long.where(x.isNotNull())
        .groupBy(*by, "label", "_i")
        .agg(F.count("*").alias("n"), F.avg(x).alias("mean"),
             (F.var_pop(x) * F.count("*")).alias("ss"))
        .select(*by, "label", F.concat(F.lit(f"{column}_"), F.col("_i")).alias("feature"),
                "n", "mean", "ss")
    )


def separation(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Within and between variance and their ratio per feature, from labels with n > 1.

    The ratio is null where the reference value is infinite (no variance within).
    """
    keys = [*by, "feature"]
    sized = with_totals(
        moments, keys, total=F.sum("n"), grand=F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    )
    many = F.col("n") > 1
    off = F.col("mean") - F.col("grand")
    return (
        sized.groupBy(*keys)
        .agg(
            (F.sum(F.when(many, F.col("ss") * F.col("n") / (F.col("n") - F.when(many, 1)
                                                            .otherwise(0)))
                   .otherwise(0.0)) / F.max("total")).alias("within"),
            (F.sum(F.when(many, F.col("n") * off * off).otherwise(0.0)) / F.max("total")).alias(
                "between"
            ),
            F.max("total").alias("n"),
        )
        .withColumn("ratio", F.when(F.col("within") > 0, ratio("between", "within")))
    )


def separation_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and range of the ratios of all features."""
    out = rows.groupBy(*by) if by else rows.groupBy()
    # one row per feature of a set: an exact percentile of some dozens of values
    return out.agg(
        F.count("ratio").alias("n_features"),
        F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("mean_ratio"),
        F.coalesce(F.percentile("ratio", 0.5), F.lit(0.0)).alias("median_ratio"),
        F.coalesce(F.min("ratio"), F.lit(0.0)).alias("min_ratio"),
        F.coalesce(F.max("ratio"), F.lit(0.0)).alias("max_ratio"),
    )


def compare_separation(df: DataFrame, features: Sequence[str], manual: str, cluster: str,
                       by: Sequence[str] = ()) -> DataFrame:
    """Separation by cluster and by hand, over labelled rows that are not noise."""
    rows = df.where(
        F.col(manual).isNotNull() & F.col(cluster).isNotNull()
        & (F.col(cluster).cast("string") != NOISE)
    )
    keys = [*by, "feature"]
    by_hand = separation(label_moments(rows, features, manual, by), by).select(
        *keys, F.col("ratio").alias("manual_ratio")
    )
    by_cluster = separation(label_moments(rows, features, cluster, by), by).select(
        *keys, F.col("ratio").alias("cluster_ratio")
    )
    return by_hand.join(by_cluster, keys).withColumn(
        "relative_quality", ratio("cluster_ratio", "manual_ratio")
    )


def top_methods_report(df: DataFrame, features: Sequence[str], manual: str,
                       ranked: Sequence[str], n: int) -> DataFrame:
    """Separation and relative quality of the first ``n`` label sets, one row each."""
    out = None
    for rank, method in enumerate(ranked[:n]):
        known = df.where(F.col(method).isNotNull() & (F.col(method).cast("string") != NOISE))
        own = separation_summary(separation(label_moments(known, features, method)))
        versus = compare_separation(df, features, manual, method).agg(
            F.avg("relative_quality").alias("relative_quality")
        )
        named = own.select(F.lit(rank).alias("rank"), F.lit(method).alias("method"), "*")
        row = beside(named, versus)
        out = row if out is None else out.unionByName(row)
    return out


def anova_from_moments(moments: DataFrame, by: Sequence[str] = (),
                       p_values: bool = True) -> DataFrame:
    """One-way F, p, share of variance explained, means and deviations per label."""
    keys = [*by, "feature"]
    sized = with_totals(
        moments, keys, total=F.sum("n"), grand=F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    )
    off = F.col("mean") - F.col("grand")
    std = F.when(F.col("n") > 1, F.sqrt(ratio("ss", F.col("n") - 1)))
    named = F.array_sort(
        F.collect_list(F.struct("label", F.col("mean").alias("m"), std.alias("s")))
    )
    rows = sized.groupBy(*keys).agg(
        F.count("*").alias("n_labels"),
        F.max("total").alias("n"),
        F.sum(F.col("n") * off * off).alias("ssb"),
        F.sum("ss").alias("ssw"),
        named.alias("_named"),
    ).where(F.col("n_labels") >= 2)
    d1, d2 = F.col("n_labels") - 1, F.col("n") - F.col("n_labels")
    rows = rows.withColumns(
        {
            "f_statistic": ratio(F.col("ssb") * d2, F.col("ssw") * d1),
            "eta_squared": F.coalesce(
                ratio("ssb", F.col("ssb") + F.col("ssw")), F.lit(0.0)
            ),
            "mean_by_label": F.map_from_entries(
                F.transform("_named", lambda s: F.struct(s["label"], s["m"]))
            ),
            "std_by_label": F.map_from_entries(
                F.transform("_named", lambda s: F.struct(s["label"], s["s"]))
            ),
        }
    ).drop("_named", "ssb", "ssw")
    if p_values:
        rows = rows.withColumn(
            "p_value", f_tail("f_statistic", d1.cast("double"), d2.cast("double"))
        )
    return rows


def anova(df: DataFrame, features: Sequence[str], label: str = "label",
          by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    return anova_from_moments(label_moments(df, features, label, by), by, p_values)


def anova_arrays(df: DataFrame, column: str, label: str = "label",
                 by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """:func:`anova` of every element of an array column."""
    return anova_from_moments(array_moments(df, column, label, by), by, p_values)


def feature_group(df: DataFrame, features: Sequence[str], keywords: Sequence[str],
                  label: str = "label", alpha: float = 0.05) -> DataFrame:
    """ANOVA of the features whose name holds one of the keywords."""
    chosen = [f for f in features if any(k in f for k in keywords)]
    if not chosen:
        raise ValueError(f"no feature matches {list(keywords)}")
    return anova(df, chosen, label).withColumn("significant", F.col("p_value") < alpha)


def fdr(results: DataFrame, p: str = "p_value", by: Sequence[str] = (),
        alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values; rows are features, ordered per group of features."""
    group = list(by) or [F.lit(1)]
    ordered = W.partitionBy(*group).orderBy(p, "feature")
    m = F.count(p).over(W.partitionBy(*group))
    ranked = results.withColumn("_raw", F.col(p) * m / F.row_number().over(ordered))
    rest = ordered.rowsBetween(0, W.unboundedFollowing)
    return (
        ranked.withColumn("p_corrected", F.least(F.lit(1.0), F.min("_raw").over(rest)))
        .withColumn("significant_corrected", F.col("p_corrected") <= alpha)
        .drop("_raw")
    )


def effect_band(eta: Column) -> Column:
    out = F.lit("negligible")
    for edge, name in reversed(EFFECT_BANDS):
        out = F.when(eta >= edge, name).otherwise(out)
    return out


def significance_summary(corrected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of significant and strong features, and the best one."""
    frame = corrected.groupBy(*by) if by else corrected.groupBy()
    eta = F.col("eta_squared")

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    return frame.agg(
        F.count("*").alias("n_features"),
        count(F.col("significant_corrected")).alias("n_significant"),
        count(F.col("p_corrected") < 0.001).alias("n_highly_significant"),
        count(eta >= 0.14).alias("n_large"),
        count(eta >= 0.06).alias("n_medium"),
        (100.0 * count(F.col("significant_corrected")) / F.count("*")).alias("significant_pct"),
        F.avg(eta).alias("mean_effect"),
        F.percentile(eta, 0.5).alias("median_effect"),
        F.max_by("feature", eta).alias("best_feature"),
    )


def means_standardized(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Mean of every feature per label, and its z-score across labels (sample deviation)."""
    rows = label_moments(df, features, label)
    w = W.partitionBy("feature")
    z = ratio(F.col("mean") - F.avg("mean").over(w), F.stddev_samp("mean").over(w))
    return rows.select("label", "feature", "mean", z.alias("z"))


def cluster_profile(df: DataFrame, features: Sequence[str], label: str = "label",
                    by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation and z of the mean across labels (population deviation, 0 -> 1)."""
    rows = label_moments(df, features, label, by)
    w = W.partitionBy(*by, "feature")
    spread = F.stddev_pop("mean").over(w)
    return rows.select(
        *by, "label", "feature", "n", "mean",
        F.when(F.col("n") > 1, F.sqrt(ratio("ss", F.col("n") - 1))).alias("std"),
        ((F.col("mean") - F.avg("mean").over(w)) / F.when(spread > 0, spread).otherwise(1.0))
        .alias("z"),
    )


def profile_distance(
    profile: DataFrame, by: Sequence[str] = (), within: float | None = None, rows: int = 256
) -> DataFrame:
    """Euclidean distance between the mean vectors of two labels.

    The profile of a group is one row per label and feature; a label with a null mean has no
    distance. The labels of a group are dealt into blocks of about ``rows``, a task compares two
    blocks. ``within`` keeps only pairs up to that distance, which never leave the task otherwise.
    """
    by = list(by)
    means = profile.where(F.col("label").isNotNull()).groupBy(*by, "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("feature", "mean"))),
                    lambda s: s["mean"]).alias("v"),
        F.min(F.col("mean").isNotNull()).alias("whole"),
    ).where("whole").drop("whole")
    dealt = blocks(means, by, "label", rows)
    fields = {f.name: f for f in means.schema.fields}
    schema = T.StructType(
        [
            *[fields[c] for c in by],
            *[T.StructField(f"label{i}", fields["label"].dataType) for i in (1, 2)],
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = split_sides(pdf)
        names, own = right["label"].to_numpy(object), left["label"].to_numpy(object)
        inside = pdf["bi"].iloc[0] == pdf["bj"].iloc[0]
        low, high, distance = [], [], []
        if len(left) and len(right):
            vectors = np.stack(right["v"].to_numpy()).astype(float)
            for label, v in zip(own, left["v"], strict=True):
                found = np.sqrt(((vectors - np.asarray(v, float)) ** 2).sum(axis=1))
                keep = names > label if inside else np.ones(len(names), bool)
                if within is not None:
                    keep = keep & (found <= within)
                # of two blocks either label may be the smaller one
                low += [min(label, other) for other in names[keep]]
                high += [max(label, other) for other in names[keep]]
                distance += found[keep].tolist()
        made = pd.DataFrame(
            {
                "label1": pd.Series(low, dtype=object),
                "label2": pd.Series(high, dtype=object),
                "distance": np.array(distance, float),
            }
        )
        for c in by:
            made[c] = pd.Series([pdf[c].iloc[0]] * len(made), dtype=object)
        return made[[f.name for f in schema.fields]]

    return dealt.groupBy(*by, "bi", "bj").applyInPandas(compare, schema)


def variation(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Coefficient of variation std / |mean| where n > 1 and the mean is not 0."""
    rows = label_moments(df, features, label)
    std = F.sqrt(ratio("ss", F.col("n") - 1))
    return rows.where((F.col("n") > 1) & (F.col("mean") != 0)).select(
        "label", "feature", ratio(std, F.abs("mean")).alias("cv")
    )


def top_discriminative(profile: DataFrame, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` features of every label that lie farthest from the others, with ``rank``."""
    w = W.partitionBy(*by, "label").orderBy(F.abs("z").desc(), "feature")
    ranked = profile.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def discriminative_spread(df: DataFrame, top: DataFrame, features: Sequence[str],
                          label: str = "label") -> DataFrame:
    """Quartiles of the top features of a label inside it and in all other labels (n >= 3).

    Values are counted once per (label, feature), in bins of the feature that all labels share. The
    other labels of a label are all labels less its own, so only totals of bins are repeated per
    label, and only values of bins that hold a quartile are looked at again.
    """
    long = unpivot(df, [label], features).where(F.col("value").isNotNull())
    counts = with_bin(value_counts(long, [label, "feature"], "value"), ["feature"], F.col("_v"))
    bins = counts.groupBy(label, "feature", "_bin").agg(F.sum("_n").alias("_bin_n"))
    bins = cut_lineage(bins, "bins")
    asked = top.select(F.col("label").alias("_of"), F.col("feature").alias("_f")).distinct()
    asked = cut_lineage(asked, "asked")
    on_own = (F.col(label) == F.col("_of")) & (F.col("feature") == F.col("_f"))
    own = bins.join(asked, on_own).select("_of", "feature", "_bin", "_bin_n")
    total = bins.groupBy("feature", "_bin").agg(F.sum("_bin_n").alias("_bin_n"))
    every = total.join(asked, F.col("feature") == F.col("_f")).select(own.columns)
    rest = every.unionByName(own.withColumn("_bin_n", -F.col("_bin_n")))
    rest = rest.groupBy("_of", "feature", "_bin").agg(F.sum("_bin_n").alias("_bin_n"))
    rest = rest.where("_bin_n > 0").withColumn("side", F.lit("others"))
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    keys = ["_of", "feature", "side"]
    spots = quantile_bins(own.withColumn("side", F.lit("this")).unionByName(rest), keys, quarters)
    inside = F.coalesce(F.col(label) == F.col("_of"), F.lit(False))
    held = counts.join(spots, ["feature", "_bin"]).where(inside == (F.col("side") == "this"))
    held = held.groupBy(*keys, "_bin", "_offset", "_total", "_v").agg(F.sum("_n").alias("_n"))
    sizes = spots.groupBy(*keys).agg(F.max("_total").alias("n"))
    out = sizes.where(F.col("n") >= 3).join(quantiles_within(held, keys, quarters), keys)
    return out.withColumnRenamed("_of", label)


def ramping(df: DataFrame, features: Sequence[str], label: str = "label",
            position: str = "repeat_pos") -> DataFrame:
    """Line through the mean of a feature by position in the run.

    Needs at least three positions and more than five rows.
    """
    aggs = [F.avg(F.col(f).cast("double")).alias(f) for f in features]
    means = df.where(F.col(position).isNotNull()).groupBy(label, position).agg(
        F.count("*").alias("_n"), *aggs
    )
    long = unpivot(means, [label, position, "_n"], features).where(F.col("value").isNotNull())
    y, x = F.col("value"), F.col(position).cast("double")
    return (
        long.groupBy(label, "feature")
        .agg(
            F.count("*").alias("n_positions"),
            F.sum("_n").alias("n"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.corr(y, x).alias("r"),
        )
        .where((F.col("n_positions") >= 3) & (F.col("n") > 5))
    )


def high_correlations(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    return pairs.where(F.abs("r") > threshold)


def redundancy_counts(pairs: DataFrame) -> DataFrame:
    """How often every feature appears among the given pairs."""
    return pairs.select(F.explode(F.array("feature1", "feature2")).alias("feature")).groupBy(
        "feature"
    ).agg(F.count("*").alias("n"))


def compare_manual_auto(df: DataFrame, features: Sequence[str], manual: str,
                        auto: str) -> DataFrame:
    """F by hand and by cluster for features with at least ten rows, with ARI and NMI."""
    rows = df.where(F.col(manual).isNotNull() & F.col(auto).isNotNull())
    a = anova(rows, features, manual, p_values=False).where(F.col("n") >= 10)
    b = anova(rows, features, auto, p_values=False).where(F.col("n") >= 10)
    joined = a.select("feature", F.col("f_statistic").alias("f_manual")).join(
        b.select("feature", F.col("f_statistic").alias("f_auto")), "feature"
    ).withColumns(
        {
            "ratio": ratio("f_auto", "f_manual"),
            "manual_better": F.col("f_manual") > F.col("f_auto"),
        }
    )
    agreement = ari(rows, [], manual, auto)
    return beside(beside(joined, agreement), nmi(rows, [], manual, auto, ignored="\0"))


def compare_subjects(df: DataFrame, feature: str, label: str = "label",
                     subject: str = "subject") -> DataFrame:
    """Effect of one feature in every subject."""
    return anova(df, [feature], label, [subject])


def composition(df: DataFrame, label: str, truth: str) -> DataFrame:
    """Share of every truth label in every cluster, the commonest one and the overall share."""
    cells = df.groupBy(F.col(label).alias("cluster"), F.col(truth).alias("truth")).agg(
        F.count("*").alias("n")
    )
    in_cluster = W.partitionBy("cluster")
    total = with_totals(cells, [], grand=F.sum("n"))
    return total.withColumns(
        {
            "cluster_n": F.sum("n").over(in_cluster),
            "truth_n": F.sum("n").over(W.partitionBy("truth")),
            "commonest": F.first("truth").over(
                in_cluster.orderBy(F.col("n").desc(), "truth").rowsBetween(
                    W.unboundedPreceding, W.unboundedFollowing
                )
            ),
        }
    ).select(
        "cluster", "truth", "n", "cluster_n",
        ratio("n", "cluster_n").alias("share"),
        ratio("truth_n", "grand").alias("overall_share"),
        "commonest",
    )


def sample_per_cluster(df: DataFrame, n: int, strategy: str = "random", key: str = "id",
                       label: str = "label", seed: int = 42, min_size: int = 5) -> DataFrame:
    """``n`` members of every cluster; smaller ones whole, below ``min_size`` and noise none.

    ``spread`` takes every ⌊size/n⌋-th member, ``representative`` the first and last third and
    random members of the middle half. Members are numbered over bins of a hash or of the key, so
    no task orders a whole cluster.
    """
    rows = df.where(F.col(label).cast("string") != NOISE)
    sized = with_totals(rows, [label], _size=F.count("*")).where(F.col("_size") >= min_size)
    order = hash_order(F.col(key), seed)
    if strategy == "random":
        w = W.partitionBy(label).orderBy(order)
        return sized.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop(
            "_i", "_size"
        )
    placed = numbered(sized, [label], key, [key], "_i")
    i, size = F.col("_i"), F.col("_size")
    if strategy == "spread":
        step = F.greatest(F.floor(size / F.lit(n)), F.lit(1))
        keep = F.when(size <= n, F.lit(True)).otherwise(
            (F.pmod(i, step) == 0) & (F.floor(i / step) < n)
        )
        return placed.where(keep).drop("_i", "_size")
    if strategy != "representative":
        raise ValueError("strategy is 'random', 'spread' or 'representative'")
    ends = n // 3
    is_end = (i < ends) | (i >= size - ends) | (size <= n)
    in_middle = (i >= F.floor(size / 4)) & (i < F.floor(3 * size / 4)) & (size > n)
    w = W.partitionBy(label).orderBy(order)
    middle = placed.where(in_middle).withColumn("_m", F.row_number().over(w))
    middle = middle.where(F.col("_m") <= n - 2 * ends).drop("_m")
    return placed.where(is_end).unionByName(middle).dropDuplicates([label, key]).drop(
        "_i", "_size"
    )
