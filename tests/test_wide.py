"""Wide tables: components without a square matrix, correlations by tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import vectors as V
from strophe.operators import wide
from strophe.operators.features import correlations


def plain_components(x, k, scale=False):
    y = x - x.mean(0)
    if scale:
        spread = x.std(0)
        y = y / np.where(spread > 0, spread, 1)
    _, s, vt = np.linalg.svd(y, full_matrices=False)
    return vt[:k].T, s[:k] ** 2 / len(x)


def test_components_of_twenty_thousand_columns(spark):
    """A basis of 20,000 x 13 is all that the driver holds."""
    j = F.sequence(F.lit(1), F.lit(20_000))
    a, b, c = (F.sin(F.col("id") * k) for k in (1.3, 2.1, 0.7))
    rows = spark.range(0, 80, 1, 4).select(
        F.lit("wide").alias("param_id"),
        "id",
        F.transform(j, lambda i: 5 * a * F.sin(i / 50) + 2 * b * F.cos(i / 9) + c * F.sin(i / 3)).alias("vec"),
    )
    found = wide.components(rows, {"wide": 3})["wide"]
    x = np.array([r.vec for r in rows.orderBy("id").collect()])
    want, variances = plain_components(x, 3)
    assert found.loadings.shape == (20_000, 3)
    assert np.allclose(found.variances, variances, rtol=1e-6)
    assert np.allclose(np.abs((found.loadings * want).sum(0)), 1, atol=1e-5)


def test_a_grid_of_point_sets(spark):
    rng = np.random.default_rng(1)
    sets = {"a": rng.normal(size=(90, 30)) * np.linspace(5, 1, 30), "b": rng.normal(size=(40, 3)) * [9, 1, 3]}
    rows = [(p, i, v.tolist()) for p, x in sets.items() for i, v in enumerate(x)] + [("unused", 0, [1.0])]
    points = spark.createDataFrame(rows, "param_id string, id long, vec array<double>")
    grid = spark.createDataFrame([("a", 4, False), ("b", 2, True), ("none", 2, True)],
                                 "param_id string, k int, scale boolean")
    got = V.embed_grid(points, grid).orderBy("param_id", "id").collect()
    assert {r.param_id for r in got} == {"a", "b"}
    for name, k, scale in (("a", 4, False), ("b", 2, True)):
        x = sets[name]
        own = np.array([r.embedding for r in got if r.param_id == name])
        want, variances = plain_components(x, k, scale)
        assert np.allclose(own.var(0), variances, rtol=1e-6)
        y = (x - x.mean(0)) / (x.std(0) if scale else 1)
        assert np.allclose(np.abs(own), np.abs(y @ want), atol=1e-3)


@pytest.mark.parametrize("tile", [2, 128])
def test_correlations_by_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(wide, "TILE", tile)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 5)) + 1e6
    x[:, 4] = 3.0
    x[:, 1] += x[:, 0]
    rows = [(["g", "h"][i % 2], *[None if rng.random() < 0.1 else float(v) for v in row]) for i, row in enumerate(x)]
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{n} double" for n in names))
    got = {(r.grp, r.feature1, r.feature2): r.r for r in correlations(df, names, ["grp"]).collect()}
    assert len(got) == 20
    for grp in "gh":
        for i, a in enumerate(names):
            for j in range(i + 1, 5):
                both = [(r[1 + i], r[1 + j]) for r in rows if r[0] == grp and None not in (r[1 + i], r[1 + j])]
                r = got[grp, a, names[j]]
                if j == 4:
                    assert r is None
                else:
                    assert r == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-7)


def test_correlations_of_a_thousand_columns(spark):
    names = [f"f{i}" for i in range(1000)]
    rows = spark.range(40).select(
        F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.sin(F.col("id") * (i + 1))).alias("v")
    ).select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    tiles = wide.pair_moments(rows, names)
    assert tiles.count() == 36
    assert max(len(r.moments) for r in tiles.collect()) <= 6 * wide.TILE**2
