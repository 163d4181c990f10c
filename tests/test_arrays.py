import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions.distances import unwrap
from strophe.operators import arrays as A
from strophe.operators import frames as FR
from strophe.params import EmbeddingParams, SpectrogramParams
from strophe.plans import array_queries as Q


def one(spark, **arrays):
    nested = {k: "array<array<double>>" if np.ndim(v) == 2 else "array<double>"
              for k, v in arrays.items()}
    schema = "id int, " + ", ".join(f"{k} {t}" for k, t in nested.items())
    return spark.createDataFrame([(0, *[np.asarray(v, float).tolist() for v in arrays.values()])],
                                 schema)


def test_unwrap_follows_numpy(spark):
    x = np.random.default_rng(0).uniform(-np.pi, np.pi, 40)
    got = one(spark, x=x).select(unwrap(F.col("x"))).first()[0]
    assert np.allclose(got, np.unwrap(x))


def test_smooth_follows_numpy(spark):
    x = np.random.default_rng(1).normal(size=50)
    for ms in (3, 4, 5):
        got = A.smooth(one(spark, samples=x), ms, 1000.0).first().samples
        assert np.allclose(got, np.convolve(x, np.ones(ms) / ms, "same"))


def test_flatten_shapes(spark):
    spec = np.arange(200).reshape(10, 20)
    base = one(spark, spec=spec, inst_freq=spec[:, :19], group_delay=spec[:9]).withColumn(
        "duration", F.lit(0.5))

    def size(*args):
        return len(A.flatten_features(base, *args).first().features)

    assert size() == 200 and size(("inst_freq",)) == 390 and size(("group_delay",)) == 380
    assert size((), 1.0) == 210 and size((), 0.0) == 200
    assert A.flatten_features(base, (), 2.0).first().features[-1] == 1.0


def test_flatten_errors(spark):
    with pytest.raises(ValueError, match="3D"):
        A.flatten_features(one(spark, spec=[1.0, 2.0]))
    empty = one(spark, spec=np.ones((1, 1))).withColumn("spec", F.expr("slice(spec, 1, 0)"))
    with pytest.raises(Exception, match="empty"):
        A.flatten_features(empty).collect()


def test_percentile_normalize(spark):
    spec = np.random.default_rng(2).normal(size=(6, 9))
    got = np.array(one(spark, spec=spec).select(A.percentile_normalize(F.col("spec"))).first()[0])
    lo, hi = np.percentile(spec, [2, 98])
    assert np.allclose(got, np.clip((spec - lo) / (hi - lo), 0, 1))


def test_phase_derivatives(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(5, 7)) + 1j * rng.normal(size=(5, 7))
    row = A.phase_derivatives(one(spark, re=z.real, im=z.imag)).first()
    inst = np.diff(np.unwrap(np.angle(z), axis=1), axis=1)
    delay = -np.diff(np.unwrap(np.angle(z), axis=0), axis=0)
    for got, want in ((row.inst_freq, inst), (row.group_delay, delay)):
        assert np.allclose(got, (want - want.min()) / (want.max() - want.min()))


def test_frames(spark):
    x = np.random.default_rng(4).normal(size=100)
    rows = FR.frame_power(one(spark, samples=x), 16, 4).orderBy("frame").collect()
    window, padded = FR.hann(16), np.concatenate([np.zeros(8), x, np.zeros(16)])
    for r in rows[:3]:
        part = padded[r.frame * 4 : r.frame * 4 + 16] * window
        basis = np.exp(-2j * np.pi * np.arange(9)[:, None] * (np.arange(16) - 8) / 16)
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), basis @ part)
    # p_max = floor((100 - 2 + 8) / 4) + 1 = 27, less the 8 that are cut
    assert len(rows) == 19


def test_resample_and_padding(spark):
    df = one(spark, x=[0.0, 1.0, 4.0])
    got = df.select(A.resample_time(F.col("x"), 5), A.pad_or_truncate(F.col("x"), 2, 0.0),
                    A.pad_or_truncate(F.col("x"), 4, -1.0)).first()
    assert got[0] == [0.0, 0.5, 1.0, 2.5, 4.0]
    assert got[1] == [0.0, 1.0] and got[2] == [0.0, 1.0, 4.0, -1.0]


def test_mean_matrix_lines_up(spark):
    base = np.zeros((2, 20))
    base[0, 5], base[1, 9] = 1.0, 2.0
    rows = [(i, "a", np.roll(base, s, 1).tolist()) for i, s in enumerate((0, 1, -2, 0))]
    df = spark.createDataFrame(rows, "id int, label string, spec array<array<double>>")
    row = A.mean_matrix(df, 20).first()
    assert np.allclose(np.array(row["mean"]).reshape(2, 20), base) and np.allclose(row["std"], 0)
    assert row.medoid == 0 and row.n == 4


def test_mel_and_cosine_weights():
    mel = FR.mel_weights(10, 512, 16000.0)
    assert mel.shape == (10, 257) and (mel >= 0).all() and (mel.sum(1) > 0).all()
    dct = FR.dct_weights(8, 8)
    assert np.allclose(dct @ dct.T, np.eye(8))


def test_short_arrays_get_null_features(spark):
    row = FR.frame_features(one(spark, samples=[0.1, 0.2]), 16, 4, 64.0).first()
    assert row.spectral_centroid_mean is None


def test_parameters_are_checked():
    assert SpectrogramParams().nfft == 1024 and EmbeddingParams().n_neighbors == 15
    for bad in ({"nfft": 0}, {"min_freq": 5000, "max_freq": 1000}):
        with pytest.raises(ValueError):
            SpectrogramParams(**bad)
    with pytest.raises(ValueError):
        EmbeddingParams(min_dist=2)


def test_concat_slices_keeps_the_places_of_a_segment_without_all_slices(spark, tmp_path):
    vectors = [(i, [float(100 * i + j) for j in range(64)], 0) for i in (0, 1, 2, 3, 4, 5, 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    found = {(r["id"], r["i"]): r["value"] for r in Q.concat_slices(spark, str(tmp_path)).collect()}
    assert found == {
        (i // 5, (j // 8) * 40 + (i % 5) * 8 + j % 8): float(100 * i + j)
        for i, _, _ in vectors for j in range(64)
    }
