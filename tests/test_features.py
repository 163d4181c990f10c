import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions import distributed as D
from strophe.functions.distributed import average_rank, exact_quantiles
from strophe.functions.tails import f_tail_value, incomplete_beta
from strophe.operators import features as X
from strophe.operators import models as M
from strophe.operators import ranking as R


def test_false_discovery_rate(spark):
    df = spark.createDataFrame([("a", .01), ("b", .04), ("c", .03), ("d", .005)],
                               "feature string, p_value double")
    got = {r.feature: r.p_corrected for r in X.fdr(df).collect()}
    assert got == pytest.approx({"a": .02, "b": .04, "c": .04, "d": .02})


def test_f_tail_with_very_many_rows():
    # P(F > 3) with 4 and infinitely many degrees of freedom is 7 * exp(-6); the rest falls as 1/d2
    limit = 7 * math.exp(-6)
    for d2 in (1e11, 1e12, 1e14, 1e16):
        assert f_tail_value(3, 4, d2) == pytest.approx(limit, rel=1e-9)
    # two degrees of freedom have a closed form
    for f, d2 in ((0.5, 3), (3, 7.5), (40, 1e3), (9, 1e9)):
        expected = math.exp(-d2 / 2 * math.log1p(2 * f / d2))
        assert f_tail_value(f, 2, d2) == pytest.approx(expected, rel=1e-9)
    # like numbers above and below: half of the mass on either side
    for d in (1e3, 1e6, 1e9):
        assert f_tail_value(1, d, d) == pytest.approx(0.5, abs=1e-9)


def test_f_tail():
    # fixed values: upper 5 % points of the F distribution from printed tables
    for f, d1, d2 in ((4.1028, 2, 10), (2.7109, 5, 20), (161.4476, 1, 1), (3.9361, 1, 100)):
        assert f_tail_value(f, d1, d2) == pytest.approx(0.05, abs=2e-5)
    assert f_tail_value(0, 2, 5) == 1 and f_tail_value(float("inf"), 2, 5) == 0
    t = np.linspace(0, 0.4, 200_001)
    y = t ** 1.5 * (1 - t) ** 2.5
    area = ((y[1:] + y[:-1]) / 2).sum() * (t[1] - t[0])
    whole = np.exp(sum(map(__import__("math").lgamma, (2.5, 3.5))) - __import__("math").lgamma(6.0))
    assert incomplete_beta(2.5, 3.5, 0.4) == pytest.approx(area / whole, rel=1e-8)


def test_anova_against_sums(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(m, 1, n) for m, n in ((0, 30), (1, 20), (3, 10))])
    g = np.repeat(["a", "b", "c"], (30, 20, 10))
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, y)], "label string, x double")
    row = X.anova(df, ["x"]).first()
    ssb = sum((g == k).sum() * (y[g == k].mean() - y.mean()) ** 2 for k in "abc")
    sst = ((y - y.mean()) ** 2).sum()
    assert row.eta_squared == pytest.approx(ssb / sst)
    assert row.f_statistic == pytest.approx((ssb / 2) / ((sst - ssb) / 57))
    assert 0 <= row.p_value < 1e-6 and set(row.mean_by_label) == {"a", "b", "c"}


def test_effect_bands(spark):
    df = spark.createDataFrame([(.2,), (.14,), (.07,), (.01,), (.001,)], "e double")
    got = [r[0] for r in df.select(X.effect_band(F.col("e"))).collect()]
    assert got == ["large", "large", "medium", "small", "negligible"]


@pytest.mark.parametrize("skew", [False, True])
def test_quantiles_and_ranks_with_a_hot_value(spark, skew):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=500), 3)
    if skew:
        x[:300] = 0.5
        x[300:400] = 1e6
    df = spark.createDataFrame([("g", float(v), i) for i, v in enumerate(x)] + [("g", None, 500)],
                               "g string, x double, i int")
    row = exact_quantiles(df, "x", {"a": .1, "b": .5, "c": .9}, ["g"]).first()
    assert [row.a, row.b, row.c] == pytest.approx(list(np.percentile(x, [10, 50, 90])))
    got = {r.i: r.r for r in average_rank(df, "x", "r", ["g"]).collect()}
    for i in (0, 150, 350, 499):
        assert got[i] == (x < x[i]).sum() + ((x == x[i]).sum() + 1) / 2
    assert got[500] == 501


def test_composite_score(spark):
    df = spark.createDataFrame([(1, .2, 2.), (2, .6, 1.), (3, None, 1.)],
                               "param_id int, silhouette double, dbi double")
    got = {r.param_id: r.composite_score
           for r in R.composite_score(df, ["silhouette", "dbi"]).collect()}
    assert got == pytest.approx({1: 0, 2: 1, 3: .5})
    same = df.withColumn("dbi", F.lit(1.0))
    first = R.composite_score(same, ["silhouette", "dbi"]).where("param_id = 1").first()
    assert first.composite_score == .5
    none = df.withColumn("dunn", F.lit(None).cast("double"))
    assert R.composite_score(none, ["dunn"]).first().composite_score == 0
    with pytest.raises(ValueError):
        R.composite_score(df, ["dbi"], [1, 2])


def test_cluster_penalty(spark):
    df = spark.createDataFrame([(20,), (21,)], "n int")
    got = [r[0] for r in df.select(R.cluster_penalty(F.col("n"))).collect()]
    assert got == pytest.approx([1.0, 0.8 * np.exp(-10)])


def labelled(spark, n=300):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, n)
    a = rng.normal(size=n) + 4 * y
    b = rng.normal(size=n)
    rows = [(i, f"l{k}", float(u), float(v), float(u * 2 + 0.01 * v))
            for i, (k, u, v) in enumerate(zip(y, a, b))]
    return spark.createDataFrame(rows, "id int, label string, a double, b double, c double"), y, a, b


def test_components_report(spark):
    df, _, a, b = labelled(spark)
    loadings, tests = M.pca_report(df, ["a", "b", "c"], k=2)
    x = np.stack([a, b, a * 2 + 0.01 * b], 1)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(z.T @ z / len(z))[::-1]
    share = {r.component: r.explained for r in loadings.collect()}
    assert share["pc1"] == pytest.approx(values[0] / 3) and tests.count() == 2


def test_discriminants_separate(spark):
    df, y, a, b = labelled(spark)
    coefficients, tests, accuracy = M.lda_report(df, ["a", "b"], folds=3)
    assert accuracy.count() == 3
    assert accuracy.agg(F.avg("accuracy")).first()[0] > 0.9
    lead = coefficients.where("discriminant = 'ld1'").collect()
    weight = {r.feature: abs(r.coefficient) for r in lead}
    assert weight["a"] > 5 * weight["b"] and lead[0].explained > 0.95
    assert tests.count() == 2


def test_consensus_and_recommendation(spark):
    df, *_ = labelled(spark)
    features = ["a", "b", "c"]
    tested = X.fdr(X.anova(df, features))
    trees, scores = M.forest_report(df, features, trees=5, depth=4, folds=2)
    assert len(scores) == 2 and min(scores) > 0.8
    tops = [M.top_by(tested, "univariate", "eta_squared", 1),
            M.top_by(trees, "forest", "importance", 1)]
    assert M.consensus(tops, 1).count() >= 1
    pairs = X.high_correlations(X.correlations(df, features))
    assert {(r.feature1, r.feature2) for r in pairs.collect()} == {("a", "c")}
    agreed = M.consensus(tops[:1], 1)
    chosen = M.recommend_features(agreed, tested, pairs, trees, 5).collect()
    assert {"a", "c"} - {r.feature for r in chosen}
    assert [r["rank"] for r in chosen] == list(range(1, len(chosen) + 1))
    methods = M.compare_methods(tops, {"forest": 0.9})
    assert {r.method: r.accuracy for r in methods.collect()} == {"forest": 0.9, "univariate": None}


def test_forests_of_several_folds_grow_at_a_time(spark, monkeypatch):
    import threading

    df, *_ = labelled(spark)
    both, grow = threading.Barrier(2), M._forest

    class Waiting:
        def __init__(self, *settings):
            self.forest = grow(*settings)

        def fit(self, rows):
            both.wait(60)
            return self.forest.fit(rows)

    monkeypatch.setattr(M, "_forest", Waiting)
    _, scores = M.forest_report(df, ["a", "b", "c"], trees=3, depth=3, folds=3)
    assert len(scores) == 3 and min(scores) > 0.5


@pytest.mark.parametrize("strategy", ["random", "spread", "representative"])
def test_samples_per_cluster(spark, strategy):
    rows = [(i, "big" if i < 90 else "small" if i < 97 else "-1" if i < 110 else "tiny")
            for i in range(113)]
    df = spark.createDataFrame(rows, "id int, label string")
    got = X.sample_per_cluster(df, 9, strategy).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"big": 9, "small": 7}


def test_registered_forests_are_whole(spark, sf, monkeypatch):
    import inspect

    from strophe.plans import model_queries as Q

    asked = []
    table = spark.createDataFrame([("c0", 1.0, 1, 2.0)],
                                  "feature string, importance double, rank int, f_statistic double")

    def forest(df, features, label="label", key="id", trees=None, depth=None, folds=None):
        asked.append((trees, depth, folds))
        return table, [1.0]

    def importances(df, features, label="label", trees=None, depth=None):
        asked.append((trees, depth))
        return table

    first = spark.createDataFrame([("ld1", "c0", 1.0)],
                                  "discriminant string, feature string, coefficient double")
    hits = spark.createDataFrame([(1.0,)], "accuracy double")
    for operator in (M.forest_report, M.forest_importances):
        defaults = inspect.signature(operator).parameters
        assert (defaults["trees"].default, defaults["depth"].default) == (100, 30)
    monkeypatch.setattr(M, "forest_report", forest)
    monkeypatch.setattr(M, "forest_importances", importances)
    monkeypatch.setattr(M, "lda_report", lambda rows, features: (first, None, hits))
    monkeypatch.setattr(M, "recommend_features", lambda *args: None)
    for query in (Q.forest_report, Q.compare_methods):
        query(spark, sf)
    for query in (Q.consensus, Q.recommend_features, Q.forest_importances):
        query(spark, sf)
    assert asked == [(100, 30, 5)] * 2 + [(100, 30)] * 3


def test_folds_are_stratified_and_coefficients_compare(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], float(rng.normal(2 * (i % 2))), float(1000 * rng.normal(2 * (i % 2)) + 1e6)) for i in range(200)]
    rows += [(200 + i, "rare", float(rng.normal(9)), float(rng.normal(1e6))) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, label string, x double, y double")
    folds = M.with_folds(df, "label", F.col("id"), 5).groupBy("label", "_fold").count().collect()
    assert {(r["label"], r["_fold"]): r["count"] for r in folds} == {
        (lab, f): n for lab, n in (("a", 20), ("b", 20), ("rare", 1)) for f in range(5)}
    plain, _, hits = M.lda_report(df.where("label <> 'rare'"), ["x", "y"])
    got = {r.feature: r.coefficient for r in plain.collect()}
    assert 0.3 < got["y"] / got["x"] < 3  # not a thousandth
    assert hits.agg(F.avg("accuracy")).first()[0] > 0.8


def test_forest_rows_of_one_file_are_dealt_out(spark):
    df, *_ = labelled(spark)
    rows = M._forest_rows(df.coalesce(1), ["a", "b"], "label", F.col("id"), 1)
    assert rows.inputFiles() and len(rows.inputFiles()) == spark.sparkContext.defaultParallelism


def test_lda_finds_its_folds_once(spark, monkeypatch):
    written = {}
    keep = M.cut_lineage

    def cut(df, name="step"):
        written[name] = df.columns
        return keep(df, name)

    monkeypatch.setattr(M, "cut_lineage", cut)
    df = spark.range(60).selectExpr(
        "id", "id % 2 AS label", "cast(id % 7 AS double) AS a", "cast(id * id % 11 AS double) AS b",
        "'a text that no report needs' AS note",
    )
    _, _, accuracy = M.lda_report(df, ["a", "b"], folds=3)
    assert written["keyed"] == ["label", "a", "b", "_key"]
    assert "_fold" in written["folded"]
    assert [r.n for r in accuracy.collect()] == [20, 20, 20]


def test_spread_repeats_no_values_per_label(spark, monkeypatch):
    rows = {}

    for module in (D, X):
        def cut(df, name="step", keep=module.cut_lineage):
            out = keep(df, name)
            rows[name] = out.count()
            return out

        monkeypatch.setattr(module, "cut_lineage", cut)
    df = spark.range(12_000).selectExpr("concat('l', id % 6) AS label", "id * 1.0D AS x")
    top = spark.createDataFrame([(f"l{i}", "x") for i in range(6)], "label string, feature string")
    got = {(r.label, r.side): r for r in X.discriminative_spread(df, top, ["x"]).collect()}
    assert len(got) == 12 and got["l0", "this"].median == 5997.0
    others = sorted(i for i in range(12_000) if i % 6)
    assert got["l0", "others"].n == 10_000
    assert got["l0", "others"].median == (others[4999] + others[5000]) / 2
    # the values once; what is written besides depends on bins, not on rows and labels
    assert rows["counts"] == 12_000 and "sides" not in rows
    assert rows["asked_bins"] <= 12 * 6
