"""Signal and matrix arrays, one row per recording or segment.

Matrices are ``array<array<double>>`` with rows along frequency and columns along time. All of this
is built from array expressions and needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.distances import (
    differences,
    neighbouring_rows,
    phase,
    unwrap,
    unwrapped_steps,
    wrapped,
)
from strophe.functions.scalars import array_sum, ratio


def mean_of(values: Column) -> Column:
    """Mean of an array in one pass over it."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        values,
        start,
        lambda acc, x: F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + x).alias("sum")),
        lambda acc: ratio(acc["sum"], acc["n"]),
    )


def std_of(values: Column) -> Column:
    """Population standard deviation of an array; the mean is taken once, not per element."""
    start = F.struct(
        F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("ss")
    )

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(
            n.alias("n"), mean.alias("mean"),
            (acc["ss"] + (x - acc["mean"]) * (x - mean)).alias("ss"),
        )

    return F.aggregate(values, start, add, lambda acc: F.sqrt(ratio(acc["ss"], acc["n"])))


def percentile_of(values: Column, q: float, ordered: bool = False) -> Column:
    """Interpolated percentile of an array."""
    ranked = values if ordered else F.array_sort(values)
    spot = (F.size(ranked) - 1) * F.lit(float(q))
    low = F.get(ranked, F.floor(spot).cast("int"))
    high = F.get(ranked, F.ceil(spot).cast("int"))
    return low + (high - low) * (spot - F.floor(spot))


def rms_norm(df: DataFrame, column: str = "samples") -> DataFrame:
    """Samples over their root mean square; a silent recording stays as it is."""
    x = F.col(column).cast("array<double>")
    power = mean_of(F.transform(x, lambda v: v * v))
    out = df.withColumn("_rms", F.sqrt(power)).withColumn(
        column, F.transform(x, lambda v: F.coalesce(ratio(v, F.col("_rms")), v))
    )
    return out.drop("_rms")


def smooth(df: DataFrame, ms: float, sample_rate: float, column: str = "samples") -> DataFrame:
    """Centred moving average of ceil(ms / 1000 * rate) taps with zeros beyond the ends."""
    taps = max(1, math.ceil(ms / 1000.0 * sample_rate))
    after = (taps - 1) // 2
    before = taps - 1 - after
    x = F.col(column).cast("array<double>")
    padded = F.concat(
        F.array_repeat(F.lit(0.0), before), x, F.array_repeat(F.lit(0.0), after)
    )
    return df.withColumn("_padded", padded).withColumn(
        column,
        F.transform(x, lambda _, i: array_sum(F.slice("_padded", i + 1, F.lit(taps))) / taps),
    ).drop("_padded")


def percentile_normalize(spec: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """Matrix clipped to [0, 1] between two of its percentiles."""
    cells = F.array_sort(F.flatten(spec))
    bounds = F.array(percentile_of(cells, low, True), percentile_of(cells, high, True))
    # bind the two numbers once per row instead of once per cell
    return F.aggregate(
        F.array(bounds),
        spec,
        lambda m, b: F.transform(
            m,
            lambda row: F.transform(
                row,
                lambda x: F.least(
                    F.lit(1.0),
                    F.greatest(
                        F.lit(0.0),
                        F.coalesce(
                            ratio(x - F.get(b, F.lit(0)), F.get(b, F.lit(1)) - F.get(b, F.lit(0))),
                            F.lit(0.0),
                        ),
                    ),
                ),
            ),
        ),
    )


def pad_or_truncate(values: Column, n: int, fill: float | None) -> Column:
    """Exactly ``n`` elements; ``fill`` (or null) beyond the last one."""
    gap = F.greatest(F.lit(n) - F.size(values), F.lit(0))
    return F.concat(
        F.slice(values, 1, n), F.array_repeat(F.lit(fill).cast("double"), gap)
    )


def pad_matrix(spec: Column, n: int, fill: float) -> Column:
    """Every row of a matrix padded or cut to ``n`` time bins."""
    return F.transform(spec, lambda row: pad_or_truncate(row, n, fill))


def pad_waveforms(df: DataFrame, column: str, by: str) -> DataFrame:
    """Arrays of a group padded with null to the longest of them."""
    longest = df.groupBy(by).agg(F.max(F.size(column)).alias("_n"))
    gap = F.array_repeat(F.lit(None).cast("double"), F.col("_n") - F.size(column))
    return df.join(longest, by).withColumn(column, F.concat(column, gap)).drop("_n")


def resample_time(values: Column, n: int) -> Column:
    """Linear interpolation of an array to ``n`` points, ends on ends."""
    step = (F.size(values) - 1) / F.lit(max(n - 1, 1))

    def at(i: Column) -> Column:
        spot = i * step
        low = F.floor(spot).cast("int")
        a = F.get(values, low)
        b = F.coalesce(F.get(values, low + 1), a)
        return a + (b - a) * (spot - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def resample_matrix(spec: Column, n: int) -> Column:
    return F.transform(spec, lambda row: resample_time(row, n))


def min_max(matrix: Column) -> Column:
    """Matrix scaled to [0, 1]; zeros where all cells are equal."""
    cells = F.flatten(matrix)
    bounds = F.array(F.array_min(cells), F.array_max(cells))
    return F.aggregate(
        F.array(bounds),
        matrix,
        lambda m, b: F.transform(
            m,
            lambda row: F.transform(
                row,
                lambda x: F.coalesce(
                    ratio(x - F.get(b, F.lit(0)), F.get(b, F.lit(1)) - F.get(b, F.lit(0))),
                    F.lit(0.0),
                ),
            ),
        ),
    )


def phase_matrix(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, phase)


def instantaneous_frequency(phases: Column) -> Column:
    """Steps of the phase unwrapped along time."""
    return F.transform(phases, unwrapped_steps)


def group_delay_along(phases: Column) -> Column:
    """Negative steps of the phase unwrapped along frequency: row against row, once over the matrix."""
    upper, lower = neighbouring_rows(phases)
    return F.zip_with(
        upper, lower, lambda a, b: F.zip_with(a, b, lambda x, y: -wrapped(y - x))
    )


def phase_derivatives(df: DataFrame, re: str = "re", im: str = "im") -> DataFrame:
    """Scaled instantaneous frequency and group delay of a complex matrix."""
    out = df.withColumn("_phase", phase_matrix(F.col(re), F.col(im)))
    out = out.withColumns(
        {
            "inst_freq": instantaneous_frequency(F.col("_phase")),
            "group_delay": group_delay_along(F.col("_phase")),
        }
    )
    return out.withColumns(
        {"inst_freq": min_max(F.col("inst_freq")), "group_delay": min_max(F.col("group_delay"))}
    ).drop("_phase")


def resultant(angles: Column) -> Column:
    """Length of the mean unit vector of an array of angles."""
    c, s = mean_of(F.transform(angles, F.cos)), mean_of(F.transform(angles, F.sin))
    return F.sqrt(c * c + s * s)


def phase_coherence(re: Column, im: Column) -> Column:
    """Per frequency: resultant length of the phase steps; 0 with fewer than two frames."""
    return F.transform(
        phase_matrix(re, im),
        lambda row: F.when(F.size(row) > 1, resultant(differences(row))).otherwise(0.0),
    )


def _gradient(values: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(values)
    return F.transform(
        values,
        lambda _, i: (
            F.get(values, F.least(i + 1, n - 1)) - F.get(values, F.greatest(i - 1, F.lit(0)))
        ) / F.when((i == 0) | (i == n - 1), 1.0).otherwise(2.0),
    )


def phase_summary(df: DataFrame, hop_time: float, re: str = "re", im: str = "im") -> DataFrame:
    """Frequency modulation, coherence and phase flux of a complex matrix with > 3 frames."""
    out = df.withColumn("_phase", phase_matrix(F.col(re), F.col(im)))
    magnitude = F.zip_with(
        re, im, lambda a, b: F.zip_with(a, b, lambda x, y: F.sqrt(x * x + y * y))
    )
    out = out.withColumns(
        {"_mag": magnitude, "_unwrapped": F.transform("_phase", unwrap)}
    )
    scale = hop_time * 2 * math.pi
    out = out.withColumns(
        {
            "_freq": F.transform(
                "_unwrapped", lambda row: F.transform(_gradient(row), lambda x: x / scale)
            ),
            "_coherence": F.transform("_phase", resultant),
            "_gate": percentile_of(F.flatten("_mag"), 0.25),
        }
    )
    rises = F.flatten(F.transform("_freq", differences))
    bends = F.flatten(F.transform("_freq", lambda row: differences(differences(row))))
    flux = F.zip_with(
        "_unwrapped",
        "_mag",
        lambda row, mag: F.transform(
            differences(row),
            lambda d, i: F.when(
                (F.get(mag, i) + F.get(mag, i + 1)) / 2 > F.col("_gate"), F.abs(d)
            ).otherwise(0.0),
        ),
    )
    out = out.withColumns({"_rises": rises, "_bends": bends, "_flux": flux})
    totals = F.transform(
        F.get("_flux", F.lit(0)),
        lambda _, t: array_sum(F.transform("_flux", lambda row: F.get(row, t))),
    )
    out = out.withColumn("_totals", totals).withColumn(
        "_high", percentile_of(F.col("_totals"), 0.9)
    )
    coherent = F.filter("_coherence", lambda x: x > 0.7)
    upward = F.filter("_rises", lambda x: x > 0)
    return out.withColumns(
        {
            "fm_rate_mean": mean_of(F.transform("_freq", std_of)),
            "fm_direction_bias": ratio(F.size(upward), F.size("_rises")),
            "fm_complexity": std_of(F.col("_bends")),
            "phase_coherence_mean": mean_of(F.col("_coherence")),
            "phase_coherence_std": std_of(F.col("_coherence")),
            "vocal_control_index": ratio(F.size(coherent), F.size("_coherence")),
            "phase_flux_mean": mean_of(F.flatten("_flux")),
            "phase_flux_peaks": F.size(F.filter("_totals", lambda x: x > F.col("_high"))),
        }
    ).drop("_phase", "_mag", "_unwrapped", "_freq", "_coherence", "_gate", "_rises", "_bends",
           "_flux", "_totals", "_high")


def flatten_features(
    df: DataFrame, channels: tuple[str, ...] = (), duration_weight: float = 0.0,
    spec: str = "spec", duration: str = "duration",
) -> DataFrame:
    """Matrix, further channels and the weighted duration as one float vector.

    The duration is repeated once per matrix row. An empty matrix fails the job.
    """
    kind = dict(df.dtypes)[spec]
    if not kind.startswith("array<array<"):
        raise ValueError(f"expected a matrix column (with rows the table is 3D), got {kind}")
    height = F.size(spec)
    full = F.when(
        (height > 0) & (F.size(F.flatten(spec)) > 0), F.flatten(spec)
    ).otherwise(F.raise_error(F.lit("cannot flatten an empty matrix")).cast("array<double>"))
    parts = [full.cast("array<float>")]
    parts += [F.flatten(c).cast("array<float>") for c in channels]
    if duration_weight:
        parts.append(
            F.array_repeat((F.col(duration) * duration_weight).cast("float"), height)
        )
    return df.withColumn("features", F.concat(*parts))


def ratio_feature(df: DataFrame, centroid: str = "spectral_centroid_mean",
                  coherence: str = "phase_coherence_mean") -> DataFrame:
    return df.withColumn(
        "spectral_phase_ratio",
        F.coalesce(centroid, F.lit(0.0)) / (F.coalesce(coherence, F.lit(1.0)) + 1e-10),
    )


def mean_matrix(df: DataFrame, width: int, label: str = "label", order: str = "id",
                max_n: int | None = None, max_shift: float = 0.15) -> DataFrame:
    """Mean and deviation of the matrices of every label after lining them up in time.

    Matrices are brought to ``width`` bins; the one with the smallest summed squared distance to all
    others is the reference, which follows from the sum of the matrices without comparing pairs;
    every matrix is rolled to where it correlates best with the reference. ``max_n`` keeps only the
    first members of a label.
    """
    rows = df
    if max_n is not None:
        w = W.partitionBy(label).orderBy(order)
        rows = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max_n).drop("_i")
    rows = rows.select(
        label, order, F.flatten(resample_matrix(F.col("spec"), width)).alias("_x"),
        F.size("spec").alias("_h"),
    )
    sums = rows.groupBy(label).agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("_x")))).alias("_s"),
    )
    dot = array_sum(F.zip_with("_x", "_s", lambda a, b: a * b))
    norm = array_sum(F.transform("_x", lambda a: a * a))
    closest = rows.join(sums, label).groupBy(label, "n").agg(
        F.min_by(F.struct("_x", F.col(order).alias("medoid")),
                 F.struct(F.round(F.col("n") * norm - 2 * dot, 9), F.col(order))).alias("_m")
    ).select(label, "n", F.col("_m._x").alias("_ref"), F.col("_m.medoid").alias("medoid"))
    reach = max(1, int(width * max_shift))
    joined = rows.join(closest, label)

    def rolled(shift: Column) -> Column:
        bands = F.transform(
            F.sequence(F.lit(0), F.col("_h") - 1), lambda b: F.slice("_x", b * width + 1, width)
        )
        cut = F.pmod(-shift, F.lit(width))
        return F.flatten(
            F.transform(
                bands,
                lambda band: F.concat(
                    F.slice(band, cut + 1, F.lit(width)), F.slice(band, F.lit(1), cut)
                ),
            )
        )

    options = F.transform(
        F.sequence(F.lit(-reach), F.lit(reach)),
        lambda s: F.struct(
            F.round(-array_sum(F.zip_with(rolled(s), "_ref", lambda a, b: a * b)), 9).alias("c"),
            s.alias("s"),
        ),
    )
    best = joined.withColumn("_shift", F.array_min(options)["s"])
    lined = best.withColumn("_v", array_to_vector(rolled(F.col("_shift"))))
    stats = lined.groupBy(label, "n", "medoid").agg(
        Summarizer.metrics("mean", "variance").summary(F.col("_v")).alias("_q")
    )
    return stats.select(
        label, "n", "medoid",
        vector_to_array("_q.mean").alias("mean"),
        F.transform(
            vector_to_array("_q.variance"),
            lambda v: F.sqrt(v * (F.col("n") - 1) / F.col("n")),
        ).alias("std"),
    )


def concat_slices(df: DataFrame, by: str = "segment_id", order: str = "slice") -> DataFrame:
    """Slices of one segment joined along time, row by row of their matrices.

    ``slices`` names the slice of every column, as a segment may lack some.
    """
    held = df.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(order, "spec"))).alias("_s")
    )
    height = F.size(F.get("_s", F.lit(0))["spec"])
    return held.select(
        by,
        F.transform(
            F.sequence(F.lit(0), height - 1),
            lambda f: F.flatten(F.transform("_s", lambda s: F.get(s["spec"], f))),
        ).alias("spec"),
        F.flatten(
            F.transform(
                "_s", lambda s: F.array_repeat(s[order], F.size(F.get(s["spec"], F.lit(0))))
            )
        ).alias("slices"),
    )
