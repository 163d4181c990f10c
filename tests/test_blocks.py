"""Work that used to take a whole group or matrix at once: compared with numpy at sizes above a block."""

import time

import numpy as np
from pyspark.sql import functions as F

from strophe.functions import distances as D
from strophe.operators import arrays as A
from strophe.operators import features as X
from strophe.operators import vectors as V


def test_profile_distance_over_blocks(spark):
    rng = np.random.default_rng(2)
    means = {(g, f"l{i}"): rng.normal(size=4) for g in ("a", None) for i in range(23)}
    rows = [(g, label, f"f{k}", float(m)) for (g, label), v in means.items() for k, m in enumerate(v)]
    rows += [("a", "gap", "f0", 1.0), ("a", "gap", "f1", None), ("a", None, "f0", 1.0)]
    profile = spark.createDataFrame(rows, "g string, label string, feature string, mean double")
    want = {
        (g, a, b): np.linalg.norm(means[g, a] - means[g, b])
        for g in ("a", None) for _, a in means for _, b in means if a < b and (g, a) in means
    }
    got = {(r["g"], r["label1"], r["label2"]): r["distance"]
           for r in X.profile_distance(profile, ["g"], rows=5).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    near = X.profile_distance(profile, ["g"], within=1.5, rows=5).count()
    assert near == sum(d <= 1.5 for d in want.values())
    plan = X.profile_distance(profile, ["g"])._jdf.queryExecution().toString()
    assert "collect_list(struct(label" not in plan.replace("named_", "")


def test_profile_distance_of_nothing(spark):
    empty = spark.createDataFrame([], "label string, feature string, mean double")
    assert X.profile_distance(empty).count() == 0


def matrix(spark, height, width):
    rng = np.random.default_rng(height)
    z = rng.normal(size=(height, width)) + 1j * rng.normal(size=(height, width))
    row = spark.createDataFrame(
        [(z.real.tolist(), z.imag.tolist())], "re array<array<double>>, im array<array<double>>"
    )
    return z, row


def test_group_delay(spark):
    z, row = matrix(spark, 6, 9)
    phases = A.phase_matrix(F.col("re"), F.col("im"))
    got = row.select(D.group_delay(phases).alias("d")).first()["d"]
    assert np.allclose(got, -np.diff(np.unwrap(np.angle(z), axis=1), axis=0))
    _, single = matrix(spark, 1, 4)
    found = A.phase_derivatives(single).first()
    assert found["group_delay"] == [] and len(found["inst_freq"][0]) == 3


def test_phase_derivatives_grow_with_the_matrix(spark):
    _, row = matrix(spark, 513, 300)
    row = row.persist()
    row.count()
    took = []
    for _ in range(2):
        begin = time.perf_counter()
        A.phase_derivatives(row).select("inst_freq", "group_delay").write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - begin)
    print(took)
    assert min(took) < 10


def test_subsample_takes_whole_rows_of_drawn_keys(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"), F.array("id").alias("vec"))
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    assert V.subsample_rows(df, 50).count() == 50
    by = V.subsample_rows(df, 20, by=["g"]).groupBy("g").count().collect()
    assert sorted(r["count"] for r in by) == [20, 20, 20]
