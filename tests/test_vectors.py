import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import clustering as C
from strophe.operators import metric_index as I
from strophe.operators import scores as K
from strophe.operators import vectors as V


def points(spark, x, labels=None, param="p"):
    labels = labels if labels is not None else ["a"] * len(x)
    rows = [(param, i, [float(v) for v in p], str(lab)) for i, (p, lab) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "param_id string, id long, vec array<double>, label string")


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_knn_is_exact_over_blocks(spark, block_rows):
    x = np.random.default_rng(1).normal(size=(60, 4))
    x[40:50] = x[3]  # copies
    found = I.knn(points(spark, x), 3, ["param_id"], block_rows).collect()
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        want = sorted((round(d[i, j], 9), j) for j in range(60) if j != i)[:3]
        got = sorted((round(r.distance, 9), r.neighbor) for r in found if r.id == i)
        assert got == want


def reference_scores(x, lab):
    d, names = distances(x), sorted(set(lab))
    sil = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if lab[j] == lab[i] and j != i]
        if not own:
            sil.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(len(x)) if lab[j] == n]].mean() for n in names if n != lab[i])
        sil.append((b - a) / max(a, b))
    core = [i for i in range(len(x)) if lab[i] != "-1"]
    inter = min(d[i, j] for i in core for j in core if lab[i] != lab[j])
    intra = max(d[i, j] for i in core for j in core if lab[i] == lab[j])
    return np.mean(sil), inter / intra


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_pair_scores_are_exact_over_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    lab = [str(v) for v in rng.integers(-1, 3, 50)]
    lab[0] = "single"
    df = points(spark, x, lab)
    sil, dunn = reference_scores(x, lab)
    assert K.silhouette(df, ["param_id"], block_rows=block_rows).first().silhouette == pytest.approx(sil)
    assert K.dunn(df, ["param_id"], block_rows).first().dunn == pytest.approx(dunn)


def test_scores_of_one_label_are_null(spark):
    df = points(spark, np.eye(4)).withColumn("truth", F.lit("t"))
    found = K.all_scores(df, ["param_id"])
    assert found.count() == len(K.METRICS) and found.where("value IS NOT NULL").count() == 0


def test_silhouette_with_as_many_labels_as_rows_is_null(spark):
    assert K.silhouette(points(spark, np.eye(3), "abc"), ["param_id"]).first().silhouette is None


def brute_density(x, eps, min_samples, min_size):
    near = distances(x) <= eps
    core = near.sum(1) >= min_samples
    comp = -np.ones(len(x), int)
    for i in range(len(x)):
        if core[i] and comp[i] < 0:
            stack, comp[i] = [i], i
            while stack:
                k = stack.pop()
                for j in np.nonzero(near[k] & core & (comp < 0))[0]:
                    comp[j] = i
                    stack.append(j)
    keep = [c for c in sorted(set(comp)) if c >= 0 and (comp == c).sum() >= min_size]
    return [keep.index(c) if c in keep else -1 for c in comp]


@pytest.mark.parametrize("seed", [0, 1])
def test_density_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(2, 0.2, (40, 2)),
                        rng.uniform(-3, 4, (40, 2)), np.repeat([[0.0, 0.0]], 60, axis=0)])
    rows = [("p", i, float(a), float(b), 0.25, 4, 5) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "param_id string, id long, x double, y double, eps double, "
                                     "min_samples int, min_cluster_size int")
    found = {r.id: r.cluster for r in C.cluster_density(df).collect()}
    assert [found[i] for i in range(len(x))] == brute_density(x, 0.25, 4, 5)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [("g", i, i + 1) for i in range(40)] + [("g", 100, i) for i in range(101, 130)]
    df = spark.createDataFrame(edges + [("h", 1, 1)], "grp string, src long, dst long")
    found = {(r.grp, r.node): r.component for r in C.connected_components(df, ["grp"]).collect()}
    assert all(found[("g", i)] == 0 for i in range(41))
    assert all(found[("g", i)] == 100 for i in range(100, 130))
    assert found[("h", 1)] == 1


def test_all_noise(spark):
    rows = [("p", i, float(i), 0.0, 0.1, 2, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "param_id string, id long, x double, y double, eps double, "
                                     "min_samples int, min_cluster_size int")
    assert {r.cluster for r in C.cluster_density(df).collect()} == {-1}


def test_pca_spans_the_data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5)) @ np.diag([5, 3, 1, 0.1, 0.1])
    found = V.embed_pca(points(spark, x), 2).orderBy("id").collect()
    got = np.array([r.embedding for r in found])
    centred = x - x.mean(0)
    _, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.sort(got.var(0) * 80)[::-1], s[:2] ** 2, rtol=1e-6)


def test_embedding_names_round_trip(spark):
    df = spark.createDataFrame(
        [("euclidean_15neighbors_0.1dist",), ("cosine_5neighbors_0.05dist_subsample200_seed7",)],
        "name string")
    a, b = V.parse_embedding_id(df, "name").collect()
    assert (a.metric, a.n_neighbors, a.min_dist, a.full) == ("euclidean", 15, 0.1, None)
    assert (b.metric, b.subsample, b.seed) == ("cosine", 200, 7)


def test_song_sampling_takes_at_least_one(spark):
    rows = [("b", f"s{i}", j) for i in range(3) for j in range(50)]
    df = spark.createDataFrame(rows, "subject string, song_id string, id int")
    assert V.subsample_by_song(df, 20).count() == 50
    assert V.subsample_by_song(df, 100).count() == 100
    assert V.subsample_by_song(df, 1000).count() == 150


def test_kmeans_finds_far_groups(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    found = {r.id: r.cluster for r in C.cluster_kmeans(points(spark, x), 3).collect()}
    groups = [{found[i] for i in range(k, k + 20)} for k in (0, 20, 40)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def clumps(groups=12, rows=40, dims=6, seed=3):
    """Well separated clumps of points."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 20, (groups, dims))
    return np.concatenate([rng.normal(c, 0.3, (rows, dims)) for c in centres])


def test_neighbour_search_opens_few_cell_pairs(spark):
    x = clumps()
    found, pairs = I.knn_with_pairs(points(spark, x), 4, ["param_id"], 20)
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(d[i])[:4]}
    assert {(r.id, r.neighbor) for r in found.collect()} == want
    leaves = I.place(points(spark, x), ["param_id"], 20).select("cell").distinct().count()
    assert leaves > 12 and pairs.count() < leaves * (leaves - 1) / 4


def test_dunn_opens_few_cell_pairs(spark):
    x = clumps()
    lab = np.repeat(np.arange(12), 40)
    found, pairs = I.extremes(points(spark, x, lab), ["param_id"], 10)
    d, same = distances(x), lab[:, None] == lab[None]
    row = found.first()
    assert row.low == pytest.approx(d[~same].min()) and row.high == pytest.approx(d[same].max())
    leaves = I.place(points(spark, x, lab), ["param_id", "label"], 10).select("label", "cell").distinct().count()
    assert pairs.count() < leaves * leaves / 8


def test_cells_of_copies_and_null_groups(spark):
    x = np.concatenate([np.zeros((50, 3)), np.random.default_rng(0).normal(size=(30, 3))])
    df = points(spark, x).withColumn("param_id", F.lit(None).cast("string"))
    found = I.knn(df, 2, ["param_id"], 8).collect()
    assert len(found) == 160 and sum(r.distance == 0 for r in found) == 100


def test_tree_cells_hold_their_rows(spark):
    placed = I.place(points(spark, clumps()), ["param_id"], 16)
    nodes = {r.cell: r for r in I.tree(placed, ["param_id"]).collect()}
    for r in placed.collect():
        for size in range(len(r.cell) + 1):
            node = nodes[r.cell[:size]]
            assert np.linalg.norm(np.array(r.vec) - node.pivot) <= node.radius + 1e-9
            assert node.is_leaf == (size == len(r.cell))


def test_silhouette_looks_at_few_labels(spark):
    x, lab = clumps(), np.repeat(np.arange(12), 40)
    df = points(spark, x, lab)
    sums = K.silhouette_sums(df, ["param_id"], 16)
    assert sums.count() < 3 * len(x)  # of 12 labels: the own one and those that may be nearest
    sil, _ = reference_scores(x, [str(v) for v in lab])
    assert K.silhouette(df, ["param_id"], block_rows=16).first().silhouette == pytest.approx(sil)


def test_blocks_grow_with_the_table_up_to_what_a_task_holds(spark):
    def sized(n, width):
        return spark.range(n).select("id", F.array_repeat(F.lit(0.5), width).alias("vec"))

    assert V.block_size(sized(100, 3)) == V.BLOCK_ROWS
    assert V.block_size(sized(80_000, 3)) == 80_000 // V.BLOCKS
    assert V.block_size(sized(80_000, 512)) == V.BLOCK_CELLS // 512
    tiles = list(V.distance_tiles(np.zeros((3, 2)), np.zeros((V.TILE_CELLS, 2))))
    assert [len(dist) for _, dist in tiles] == [1, 1, 1]


def test_distance_tiles_hold_one_array():
    import tracemalloc

    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(300, 5)), rng.normal(size=(V.TILE_CELLS // 100, 5))
    tracemalloc.start()
    for start, dist in V.distance_tiles(left, right):
        plain = np.sqrt(((left[start : start + 2, None] - right[None]) ** 2).sum(axis=2))
        assert np.allclose(dist[:2], plain, atol=1e-9)
        del plain
        tracemalloc.reset_peak()
    for _, dist in V.distance_tiles(left, right):
        del dist
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a tile and the one before it: no other array of that size is made
    assert peak < 8 * V.TILE_CELLS * 2.5
