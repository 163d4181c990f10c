"""Order statistics over groups with outliers, copies, nulls and infinities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions import distributed as D


def test_an_outlier_does_not_fill_one_bin(spark):
    values = spark.range(100_000).select(
        F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") * 0.001).alias("v")
    )
    sizes = [r["count"] for r in D._binned(values, [], "v").groupBy("_bin").count().collect()]
    assert max(sizes) < 2_000 and sum(sizes) == 100_000
    rows = D.numbered(values, [], "v", ["v"], "at")
    assert rows.where("at = 99999").first().v == 1e12
    assert rows.agg(F.countDistinct("at")).first()[0] == 100_000


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_and_quantiles_are_exact(spark, descending):
    rng = np.random.default_rng(3)
    groups = {
        "few": [1.0, 1.0, 2.0],
        "one": [5.0],
        "skewed": [*rng.lognormal(0, 6, 800), *[7.0] * 300, float("inf"), float("-inf")],
        "none": [None, None],
    }
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate([*map(lambda v: None if v is None else float(v), vs), None])]
    df = spark.createDataFrame(rows, "grp string, i int, v double")
    ranked = D.average_rank(df, "v", "rank", ["grp"], descending).collect()
    found = {r.grp: r for r in D.exact_quantiles(df, "v", {"q1": 0.25, "mid": 0.5}, ["grp"]).collect()}
    for g, vs in groups.items():
        known = np.array([v for v in vs if v is not None], float)
        for r in ranked:
            if r.grp == g and r.v is not None:
                ahead = (known > r.v).sum() if descending else (known < r.v).sum()
                assert r["rank"] == ahead + ((known == r.v).sum() + 1) / 2
        if len(known):
            assert found[g].mid == pytest.approx(np.quantile(known, 0.5))
            assert found[g].q1 == pytest.approx(np.quantile(known, 0.25))


def test_few_groups_are_not_as_many_tasks(spark, monkeypatch):
    written = {}
    keep = D.cut_lineage

    def cut(df, name="step"):
        out = keep(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(D, "cut_lineage", cut)
    df = spark.range(20_000).selectExpr("id % 2 AS g", "cast(id AS double) AS v")
    got = {r.g: r.mid for r in D.exact_quantiles(df, "v", {"mid": 0.5}, ["g"]).collect()}
    assert got == {0: 9_999.0, 1: 10_000.0}
    # every distinct value once, edges once a group and the bins of two ranks a group
    assert written == {"counts": 20_000, "edges": 2, "asked_bins": written["asked_bins"]}
    assert written["asked_bins"] <= 4
    plan = D.with_bin(keep(df), ["g"], F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "lambda" not in plan


def test_bins_of_odd_values(spark):
    values = [None, float("-inf"), -1e12, -0.5, 0.0, 0.0, 3.0, 1e12, float("inf"), float("nan")]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    placed = D.numbered(df, ["g"], "v", [F.col("v").asc_nulls_last()], "at").orderBy("at").collect()
    assert [str(r.v) for r in placed] == [str(v) for v in [*values[1:], None]]


def test_given_bins_number_like_found_ones(spark):
    df = spark.range(2_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 3).alias("g"))
    found = D.numbered(df, ["g"], "k", ["k"], "at").collect()
    given = D.numbered(df, ["g"], "k", ["k"], "at", F.shiftright("k", 48)).collect()
    assert sorted(found) == sorted(given)
