"""Short-time spectra and what is summed up from them.

The transform itself runs in numpy, one batch of rows at a time; everything after it works on the
frame table ``(id, frame, samples, re, im)`` with array expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.distributed import beside
from strophe.functions.scalars import array_sum, ratio
from strophe.operators.arrays import mean_of
from strophe.session import spread

TINY = 1e-10


def hann(nfft: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nfft) / nfft)


def _framed(x: np.ndarray, nfft: int, hop: int, trim: bool) -> np.ndarray:
    """Frames centred on multiples of ``hop``, from time 0 on, without those past the signal."""
    half = nfft // 2
    count = (len(x) - 2 + half) // hop + 1 - (half if trim else 0)
    if len(x) < 2 or count <= 0:
        return np.empty((0, nfft))
    padded = np.concatenate([np.zeros(half), x, np.zeros(nfft)])
    return np.lib.stride_tricks.sliding_window_view(padded, nfft)[: count * hop : hop][:count]


def frame_power(df: DataFrame, nfft: int, hop: int, column: str = "samples", key: str = "id",
                trim: bool = True) -> DataFrame:
    """Hann spectra of every recording, phases taken at the middle of the frame.

    ``trim`` also cuts the last nfft / 2 frames. Filter recordings before this operator: filters
    are not pushed below it.
    """
    kind = dict(df.dtypes)[key]
    schema = (
        f"{key} {kind}, frame int, samples array<double>, re array<double>, im array<double>"
    )
    window = hann(nfft)

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, samples in zip(pdf[key], pdf[column]):
                frames = _framed(np.asarray(samples, dtype=np.float64), nfft, hop, trim)
                if not len(frames):
                    continue
                z = np.fft.rfft(np.roll(frames * window, -(nfft // 2), axis=1), axis=1)
                yield pd.DataFrame(
                    {
                        key: name,
                        "frame": np.arange(len(frames), dtype=np.int32),
                        "samples": list(frames),
                        "re": list(z.real),
                        "im": list(z.imag),
                    }
                )

    return spread(df.select(key, column), key).mapInPandas(spectra, schema)


def magnitudes() -> Column:
    return F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))


def log_magnitude(frames: DataFrame) -> DataFrame:
    """Natural logarithm of the magnitude per frame; null where it is zero."""
    return frames.withColumn(
        "log_mag", F.transform(magnitudes(), lambda m: F.when(m > 0, F.ln(m)))
    )


def bin_frequencies(nfft: int, sample_rate: float) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(nfft // 2)), lambda k: k * F.lit(sample_rate / nfft)
    )


def band_filter(frames: DataFrame, nfft: int, sample_rate: float, low: float, high: float
                ) -> DataFrame:
    """Spectra cut to the frequency bins between two limits."""
    width = sample_rate / nfft
    first, last = math.ceil(low / width), min(math.floor(high / width), nfft // 2)
    return frames.withColumns(
        {c: F.slice(c, first + 1, max(last - first + 1, 0)) for c in ("re", "im")}
    )


def pre_emphasis(df: DataFrame, coefficient: float = 0.97, column: str = "samples") -> DataFrame:
    """Every sample less a share of the one before; the first is extrapolated backwards."""
    x = F.col(column).cast("array<double>")
    return df.withColumn("_x", x).withColumn(
        column,
        F.transform(
            "_x",
            lambda v, i: v - coefficient * F.when(i > 0, F.get("_x", i - 1)).otherwise(
                2 * F.get("_x", F.lit(0)) - F.coalesce(F.get("_x", F.lit(1)), F.lit(0.0))
            ),
        ),
    ).drop("_x")


def _decibel(x: Column) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(TINY)))


def _band_level(low: float, high: float, share: float) -> Column:
    """Decibels between the loudest and the quietest bins of one band; null without bins."""
    inside = F.array_sort(
        F.transform(
            F.filter(
                F.arrays_zip("freq", "mag"), lambda z: (z["freq"] >= low) & (z["freq"] < high)
            ),
            lambda z: z["mag"],
        )
    )
    k = F.greatest(F.round(F.size(inside) * share).cast("int"), F.lit(1))
    quiet = mean_of(F.slice(inside, F.lit(1), k))
    loud = mean_of(F.slice(inside, F.greatest(F.size(inside) - k + 1, F.lit(1)), k))
    return F.when(F.size(inside) > 0, _decibel(loud) - _decibel(quiet))


def _contrast(sample_rate: float, bands: int = 6, low: float = 200.0, share: float = 0.02) -> Column:
    """Mean level over octave bands from ``low`` Hz on and the band below."""
    edges = [0.0, *[low * 2**i for i in range(bands + 1)]]
    levels = [
        _band_level(a, b, share) for a, b in zip(edges, edges[1:]) if a < sample_rate / 2
    ]
    return mean_of(F.array_compact(F.array(*levels)))


def frame_measures(frames: DataFrame, nfft: int, sample_rate: float, key: str = "id",
                   rolloff: float = 0.85) -> DataFrame:
    """Per frame: centroid, bandwidth, rolloff, contrast, zero crossings, energy, onset strength."""
    rows = frames.withColumns(
        {"mag": magnitudes(), "freq": bin_frequencies(nfft, sample_rate)}
    ).withColumns(
        {
            "_total": array_sum(F.col("mag")),
            "_level": F.transform("mag", lambda m: _decibel(m * m)),
        }
    )
    centroid = ratio(array_sum(F.zip_with("freq", "mag", lambda f, m: f * m)), "_total")
    rows = rows.withColumn("spectral_centroid", centroid)
    spread = F.zip_with(
        "freq", "mag",
        lambda f, m: m * (f - F.col("spectral_centroid")) * (f - F.col("spectral_centroid")),
    )
    reached = F.aggregate(
        "mag",
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("bins")),
        lambda acc, m: F.struct(
            (acc["sum"] + m).alias("sum"),
            (acc["bins"] + F.when(acc["sum"] + m < rolloff * F.col("_total"), 1).otherwise(0))
            .alias("bins"),
        ),
        lambda acc: acc["bins"],
    )
    n = F.size("samples")
    crossings = F.size(
        F.filter(
            F.zip_with(
                F.slice("samples", F.lit(1), n - 1),
                F.slice("samples", F.lit(2), n - 1),
                lambda a, b: (a < 0) != (b < 0),
            ),
            lambda crossed: crossed,
        )
    )
    before = F.lag("_level").over(W.partitionBy(key).orderBy("frame"))
    rows = rows.withColumn("_before", before)
    rise = mean_of(
        F.zip_with("_level", "_before", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    )
    return rows.select(
        key,
        "frame",
        "spectral_centroid",
        F.sqrt(ratio(array_sum(spread), "_total")).alias("spectral_bandwidth"),
        (reached * F.lit(sample_rate / nfft)).alias("spectral_rolloff"),
        _contrast(sample_rate).alias("spectral_contrast"),
        ratio(crossings, n).alias("zero_crossing_rate"),
        F.sqrt(mean_of(F.transform("samples", lambda x: x * x))).alias("rms_energy"),
        F.coalesce(rise, F.lit(0.0)).alias("onset_strength"),
    )


MEASURES = ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_contrast",
            "zero_crossing_rate", "rms_energy", "onset_strength")


def frame_features(df: DataFrame, nfft: int, hop: int, sample_rate: float, key: str = "id",
                   column: str = "samples") -> DataFrame:
    """Mean and population deviation of every frame measure; null for arrays below one hop."""
    long = df.where(F.size(column) >= hop)
    measured = frame_measures(
        frame_power(long, nfft, hop, column, key, trim=False), nfft, sample_rate, key
    )
    stats = measured.groupBy(key).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in MEASURES],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in MEASURES],
    )
    return df.select(key).join(stats, key, "left")


def mel_weights(n_mels: int, nfft: int, sample_rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, of equal area."""
    def to_mel(f: np.ndarray) -> np.ndarray:
        linear = 3 * f / 200.0
        return np.where(f >= 1000, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4), linear)

    def to_hz(m: np.ndarray) -> np.ndarray:
        return np.where(m >= 15, 1000 * np.exp(np.log(6.4) / 27 * (m - 15)), 200.0 * m / 3)

    bins = np.arange(nfft // 2 + 1) * sample_rate / nfft
    edges = to_hz(np.linspace(0, to_mel(np.array(sample_rate / 2.0)), n_mels + 2))
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    shape = np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))
    return np.maximum(shape, 0) * 2 / (high - low)


def dct_weights(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal cosine transform."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    out = np.cos(np.pi * k * (2 * i + 1) / (2 * n_in)) * math.sqrt(2.0 / n_in)
    out[0] /= math.sqrt(2.0)
    return out


def _beside(df: DataFrame, **matrices: np.ndarray) -> DataFrame:
    """Constant matrices carried beside every row."""
    schema = ", ".join(f"{n} array<array<double>>" for n in matrices)
    row = [tuple(m.tolist() for m in matrices.values())]
    return beside(df, df.sparkSession.createDataFrame(row, schema))


def _times(matrix: str, vector: Column) -> Column:
    return F.transform(matrix, lambda row: array_sum(F.zip_with(row, vector, lambda a, b: a * b)))


def mfcc_frames(frames: DataFrame, nfft: int, sample_rate: float, n: int = 13, n_mels: int = 128,
                key: str = "id") -> DataFrame:
    """Cepstral coefficients per frame: mel filters, decibels, cosine transform."""
    rows = _beside(
        frames, _mel=mel_weights(n_mels, nfft, sample_rate), _dct=dct_weights(n, n_mels)
    )
    rows = rows.withColumn("_power", F.zip_with("re", "im", lambda a, b: a * a + b * b))
    rows = rows.withColumn("_db", F.transform(_times("_mel", F.col("_power")), _decibel))
    return rows.select(key, "frame", _times("_dct", F.col("_db")).alias("mfcc"))


def mfcc(df: DataFrame, nfft: int, hop: int, sample_rate: float, n: int = 13, n_mels: int = 128,
         key: str = "id", column: str = "samples") -> DataFrame:
    """Mean and population deviation of every coefficient over the frames."""
    frames = frame_power(df, nfft, hop, column, key, trim=False)
    rows = mfcc_frames(frames, nfft, sample_rate, n, n_mels, key)
    stats = rows.select(
        key, *[F.get("mfcc", F.lit(i)).alias(f"_c{i}") for i in range(n)]
    ).groupBy(key).agg(
        F.array(*[F.avg(f"_c{i}") for i in range(n)]).alias("mfcc_means"),
        F.array(*[F.stddev_pop(f"_c{i}") for i in range(n)]).alias("mfcc_stds"),
    )
    return stats


def f0_frames(frames: DataFrame, nfft: int, sample_rate: float, low: float = 300.0,
              high: float = 8000.0, key: str = "id") -> DataFrame:
    """Pitch per frame: the loudest bin between two limits, null in silence."""
    pairs = F.filter(
        F.arrays_zip(
            magnitudes().alias("mag"), bin_frequencies(nfft, sample_rate).alias("freq")
        ),
        lambda z: (z["freq"] >= low) & (z["freq"] <= high),
    )
    loudest = F.array_max(F.transform(pairs, lambda z: F.struct(z["mag"], -z["freq"])))
    return frames.select(key, "frame", loudest.alias("_p")).select(
        key, "frame", F.when(F.col("_p.mag") > TINY, -F.col("_p.col2")).alias("f0")
    )


def f0_summary(df: DataFrame, nfft: int, hop: int, sample_rate: float, low: float = 300.0,
               high: float = 8000.0, key: str = "id", column: str = "samples") -> DataFrame:
    """Mean, deviation, range of the pitch and share of voiced frames."""
    frames = frame_power(df, nfft, hop, column, key, trim=False)
    return (
        f0_frames(frames, nfft, sample_rate, low, high, key)
        .groupBy(key)
        .agg(
            F.avg("f0").alias("f0_mean"),
            F.stddev_pop("f0").alias("f0_std"),
            F.min("f0").alias("f0_min"),
            F.max("f0").alias("f0_max"),
            (F.max("f0") - F.min("f0")).alias("f0_range"),
            ratio(F.count("f0"), F.count("*")).alias("f0_voiced_fraction"),
        )
    )


def autocorrelation_power(df: DataFrame, key: str = "id", column: str = "samples") -> DataFrame:
    """Power spectrum of the centred autocorrelation of an array."""
    kind = dict(df.dtypes)[key]

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, samples in zip(pdf[key], pdf[column]):
                x = np.asarray(samples, dtype=np.float64)
                n = len(x)
                z = np.fft.rfft(x, 2 * n)
                full = np.fft.irfft(z * np.conj(z), 2 * n)
                lags = np.concatenate([full[-(n - 1):], full[:n]]) if n > 1 else full[:1]
                start = (len(lags) - n) // 2
                same = lags[start : start + n]
                out.append((name, n, np.abs(np.fft.rfft(same)) ** 2))
            yield pd.DataFrame(out, columns=[key, "n", "power"])

    return df.select(key, column).mapInPandas(spectra, f"{key} {kind}, n int, power array<double>")


def autocorr_tempo(df: DataFrame, sample_rate: float, height: float, low: float = 0.125,
                   high: float = 30.0, slow: float = 3.0, key: str = "id",
                   column: str = "samples") -> DataFrame:
    """Tempo from peaks of the power spectrum of the energy's autocorrelation.

    ``df`` holds the smoothed energy. Peaks are local maxima between ``low`` and ``high`` Hz above
    ``height``: mean of the three strongest, mean below ``slow`` Hz, mean of all.
    """
    spectra = autocorrelation_power(df, key, column)
    band = F.filter(
        F.transform(
            "power",
            lambda p, i: F.struct(p.alias("p"), (i * F.lit(sample_rate) / F.col("n")).alias("f")),
        ),
        lambda z: (z["f"] >= low) & (z["f"] <= high),
    )
    rows = spectra.withColumn("_band", band)
    peaks = F.filter(
        F.transform(
            "_band",
            lambda z, i: F.struct(
                z["p"].alias("p"), z["f"].alias("f"),
                ((i > 0) & (i < F.size("_band") - 1)
                 & (z["p"] > F.get("_band", i - 1)["p"]) & (z["p"] > F.get("_band", i + 1)["p"]))
                .alias("top"),
            ),
        ),
        lambda z: F.coalesce(z["top"], F.lit(False)) & (z["p"] >= height),
    )
    rows = rows.withColumn("_peaks", peaks)
    strongest = F.slice(F.sort_array("_peaks", asc=False), 1, 3)

    def freq_mean(values: Column) -> Column:
        return mean_of(F.transform(values, lambda z: z["f"]))

    return rows.select(
        key,
        F.size("_peaks").alias("n_peaks"),
        freq_mean(strongest).alias("tempo_top3"),
        freq_mean(F.filter("_peaks", lambda z: z["f"] < slow)).alias("tempo_slow"),
        freq_mean(F.col("_peaks")).alias("tempo_all"),
    )


