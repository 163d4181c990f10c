import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import forests as O
from strophe.operators import models as M


def plain(x, y, w, judged, k, depth):
    """A tree that looks at every feature and cut of every node, one after the other."""
    total = np.bincount(y, w, k)
    gains, shares = np.zeros(x.shape[1]), np.tile(total / total.sum(), (len(judged), 1))
    found = []
    for f in range(x.shape[1]) if depth else []:
        for c in range(O.BINS):
            low = x[:, f] <= c
            if low.any() and not low.all():
                a, b = np.bincount(y[low], w[low], k), np.bincount(y[~low], w[~low], k)
                kept = (a * a).sum() / a.sum() + (b * b).sum() / b.sum()
                found.append((kept - (total * total).sum() / total.sum(), -f, -c))
    gain, f, c = max(found, default=(0, 0, 0))
    if gain > 1e-9:
        gains[-f] = gain
        low, under = x[:, -f] <= -c, judged[:, -f] <= -c
        for side, ask in ((low, under), (~low, ~under)):
            more, shares[ask] = plain(x[side], y[side], w[side], judged[ask], k, depth - 1)
            gains += more
    return gains, shares


@pytest.mark.parametrize("depth", [0, 1, 3, 30])
def test_grown_tree_is_that_of_a_plain_search(depth):
    rng = np.random.default_rng(0)
    x = rng.integers(0, O.BINS, (400, 3)).astype(np.uint8)
    y = (x[:, 0].astype(int) + 2 * x[:, 1] > 50) + (x[:, 2] > 25) * 1
    y[rng.random(400) < 0.1] = 2
    w, judged = rng.integers(1, 5, 400), rng.integers(0, O.BINS, (50, 3)).astype(np.uint8)
    gains, _ = O.grow(x, y, w, judged, 3, depth, 3, np.random.default_rng(1))
    expected, shares = plain(x, y, w.astype(float), judged, 3, depth)
    if depth < 30:  # deep down equal gains are common, and any of them may be taken
        assert gains == pytest.approx(expected)
        got = O.grow(x, y, w, judged, 3, depth, 3, np.random.default_rng(1))[1]
        assert got == pytest.approx(shares)
    order = rng.permutation(400)
    again = O.grow(x[order], y[order], w[order], judged, 3, depth, 3, np.random.default_rng(1))
    assert again[0] == pytest.approx(gains) and gains.sum() == pytest.approx(expected.sum(), rel=0.05)


def noisy(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    a, b, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = np.where(2 * a + b + noise > 0, "x", "y")
    rows = zip(range(n), y.tolist(), a.tolist(), b.tolist(), noise.tolist())
    return spark.createDataFrame(list(rows), "id long, label string, a double, b double, c double")


def test_no_pass_per_level_and_no_tree_on_the_driver(spark, monkeypatch):
    df, held = noisy(spark, 3000), []
    table = M._importance_table
    monkeypatch.setattr(M, "_importance_table", lambda *args: held.append(args[1]) or table(*args))

    def jobs(depth):
        group = f"depth {depth}"
        spark.sparkContext.setJobGroup(group, group)
        M.forest_importances(df, ["a", "b", "c"], trees=4, depth=depth)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        assert jobs(30) == jobs(3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(not hasattr(whole, "totalNumNodes") for whole in held)


def test_large_nodes_are_split_by_all_tasks(spark, monkeypatch):
    df = noisy(spark, 3000).repartition(4)
    features = ["a", "b", "c"]
    rows = M._forest_rows(df, features, "label", F.col("id"), 3)

    def grown(trees, top):
        monkeypatch.setattr(O, "NODE_ROWS", top)
        return M._grower(rows, features, trees, 30, 7)(1)

    whole, parts = grown(1, 1 << 17), grown(1, 100)
    assert parts.featureImportances == pytest.approx(whole.featureImportances, abs=0.03)
    assert parts.accuracy == pytest.approx(whole.accuracy, abs=0.03)
    whole, parts = grown(20, 1 << 17), grown(20, 100)
    assert parts.accuracy == pytest.approx(whole.accuracy, abs=0.03) and parts.accuracy > 0.9
    # what is sent on to one task is no larger than allowed
    held = F.col("_fold") == 1
    asked = rows.select("_row", F.col("_y").cast("int"), held.alias("_held"), *features)
    asked = O.binned(asked, features, O.cuts(rows, features))
    forest = O.Forest(3, 30, 7, 3, 2)
    tops, _ = forest._tops(asked)
    x = np.stack([np.frombuffer(r._x, "u1") for r in asked.orderBy("_row").collect()])
    row, out = np.array([(r._row, r._held) for r in asked.orderBy("_row").collect()]).T
    for tree, top in enumerate(tops):
        w = O.drawn(row, tree, 7) * (out == 0)
        sizes = np.bincount(forest._place(x, top), w, len(top))
        assert len(top) > 20
        assert all(s <= 100 for s, known in zip(sizes, top, strict=True) if known is None)
        assert [t.total.sum() for t in top if t and t.left < 0] == [
            s for s, known in zip(sizes, top, strict=True) if known and known.left < 0]


def test_cuts_tell_few_values_apart_and_follow_quantiles(spark):
    df = spark.range(10_000).selectExpr(
        "cast(id AS double) AS even", "cast(CASE WHEN id < 9990 THEN 0 ELSE id % 3 END AS double) AS rare",
        "1.0D AS same", "exp(id / 100.0) AS steep",
    )
    even, rare, same, steep = O.cuts(df, df.columns)
    assert rare.tolist() == [0.0, 1.0] and same.tolist() == []
    shares = [(i + 1) / O.BINS for i in range(O.BINS - 1)]
    assert even / 10_000 == pytest.approx(shares, abs=2e-3)
    assert np.log(steep) / 100 == pytest.approx(shares, abs=2e-3)
    x = O.binned(df.limit(5), df.columns, [even, rare, same, steep]).collect()
    assert {tuple(r._x) for r in x} == {(0, 0, 0, 0)}


def test_draws_are_those_of_a_sample_with_repeats():
    a, b = (O.drawn(np.arange(100_000), tree, 42) for tree in (0, 1))
    assert a.mean() == pytest.approx(1, abs=0.02) and a.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02
    assert (O.drawn(np.arange(50, 100), 0, 42) == a[50:100]).all()
