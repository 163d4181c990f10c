import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strophe.operators import phenotype as P
from strophe.operators import sequences as S
from strophe.params import END, START, PhenotypeParams


def make(spark, songs, size=1000, subject="b"):
    """Sequence of one subject from lists of labels, in chunks of ``size`` rows."""
    rows = [(subject, f"s{i:03d}", j, lab) for i, song in enumerate(songs)
            for j, lab in enumerate(song)]
    df = spark.createDataFrame(rows, "subject string, song string, pos int, label string")
    return S.sequence(
        df, subject=F.col("subject"), song=F.col("song"), order=[F.col("pos")],
        label=F.col("label"), chunk=S.chunk_of_position(F.col("pos"), size),
    )


def counts(df):
    return {(r["from"], r["to"]): r["n"] for r in df.collect()}


def expected_counts(songs):
    out = Counter()
    for song in songs:
        tokens = [START, *song, END]
        out.update(zip(tokens, tokens[1:]))
    return dict(out)


def expected_runs(songs):
    out = Counter()
    for song in songs:
        i = 0
        while i < len(song):
            j = i
            while j < len(song) and song[j] == song[i]:
                j += 1
            out[(song[i], j - i)] += 1
            i = j
    return dict(out)


T1 = [["a", "a", "b"], ["a", "b"]]


def test_toy_phenotype(spark):
    row = P.phenotype(make(spark, T1)).first()
    assert row.n_songs == 2 and row.n_segments == 5 and row.repertoire_size == 2
    assert row.entropy == pytest.approx(0.636514, abs=1e-6)
    assert row.entropy_scaled == pytest.approx(0.381909, abs=1e-6)
    assert row.repeat_bool and row.dyad_bool and row.num_dyad == 1 and row.num_longer == 0
    assert row.mean_repeat == row.median_repeat == row.var_repeat == 0
    assert row.intro_labels == ["a"] and row.intro_recurs
    assert row.mean_intro == 1.5 and row.std_intro == 0.5
    assert row.intro_runs == {2: 1, 1: 1}
    assert row.entropy_no_intro == 0


def test_toy_transitions(spark):
    found = S.transitions(make(spark, T1))
    assert counts(found) == {(START, "a"): 2, ("a", "a"): 1, ("a", "b"): 2, ("b", END): 2}
    probs = {(r["from"], r["to"]): r.p for r in S.transition_probabilities(found).collect()}
    assert probs[("a", "a")] == pytest.approx(1 / 3)
    assert probs[("a", "b")] == pytest.approx(2 / 3)
    assert probs[("b", END)] == 1 and probs[(START, "a")] == 0
    out = {(r["from"], r["to"]): r.p for r in S.transition_probabilities(found, "out").collect()}
    assert out[(START, "a")] == 1


def test_empty_subject(spark):
    seq = make(spark, [["a"]]).where("label = 'z'")
    subjects = spark.createDataFrame([("b",)], "subject string")
    row = P.phenotype(seq, subjects=subjects).first()
    assert row.entropy is None and row.repertoire_size is None
    assert row.repeat_bool is False and row.num_dyad == 0 and row.n_songs == 0
    table = P.phenotype_table(P.phenotype(seq, subjects=subjects), None).collect()
    assert [(r["rank"], r.n_songs) for r in table] == [("0", 0)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_chunks_do_not_matter(spark, size):
    rng = random.Random(size)
    songs = [[rng.choice("aab") for _ in range(rng.randint(1, 25))] for _ in range(12)]
    seq = make(spark, songs, size)
    assert counts(S.transitions(seq)) == expected_counts(songs)
    hist = S.run_lengths(seq).groupBy("label", "length").count().collect()
    assert {(r.label, r.length): r["count"] for r in hist} == expected_runs(songs)
    one = [[x for song in songs for x in song]]
    assert counts(S.transitions(seq, "subject")) == expected_counts(one)
    merged = S.run_lengths(S.merge_songs(seq, "subject")).groupBy("label", "length").count()
    assert {(r.label, r.length): r["count"] for r in merged.collect()} == expected_runs(one)
    positions = S.with_positions(seq).collect()
    assert all(songs[int(r.song_id[1:])][r.pos] == r.label for r in positions)
    placed = {(r.song_id, r.pos): r.repeat_pos
              for r in S.repeat_position(S.with_positions(seq)).collect()}
    for i, song in enumerate(songs):
        run = 0
        for j, lab in enumerate(song):
            run = run + 1 if j and song[j - 1] == lab else 1
            assert placed[(f"s{i:03d}", j)] == run


@pytest.mark.parametrize("size", [2, 1000])
def test_phenotype_matches_single_operators(spark, size):
    rng = random.Random(5)
    songs = [["i"] * rng.randint(0, 4) + [rng.choice("abbc") for _ in range(rng.randint(1, 15))]
             for _ in range(20)]
    params = PhenotypeParams(repeat_significance=0.2, dyad_share=0.6)
    seq = make(spark, songs, size)
    row = P.phenotype(seq, params).first()
    runs = S.run_lengths(seq)
    vocab = S.vocabulary(S.label_counts(runs))
    hist = S.significant_repeats(S.repeat_histogram(runs), vocab, 0.2)
    stats = S.repeat_stats(hist, 0.6).first()
    for name in ("num_dyad", "num_longer", "mean_repeat", "median_repeat", "var_repeat",
                 "skew_repeat", "kurt_repeat"):
        assert row[name] == pytest.approx(stats[name], abs=1e-9), name
    intro = S.intro_labels(runs)
    intros = S.intro_stats(runs, intro, S.label_counts(runs)).first()
    for name in ("intro_labels", "intro_recurs", "intro_runs"):
        assert row[name] == intros[name]
    rest = S.without_intro(runs, intro)
    probs = S.transition_probabilities(S.transitions(rest))
    assert row.entropy_no_intro == pytest.approx(S.entropy(probs).first().entropy, abs=1e-9)


def windows(song, low=2, high=19):
    """The recurrence written out on one label: windows counted, then taken away."""
    raw = Counter()
    for start in range(len(song)):
        run = 1
        while start + run < len(song) and song[start + run] == song[start] and run < high:
            run += 1
        if song[start] == "a":
            raw.update(range(low, run + 1))
    for longer in range(high, low, -1):
        for shorter in range(longer - 1, low - 1, -1):
            raw[shorter] = max(0, raw[shorter] - raw[longer] * (longer - shorter + 1))
    return {k: v for k, v in raw.items() if v}


@pytest.mark.parametrize("lengths", [[19], [20], [25, 3, 3], [2, 2, 5, 19], [40, 18]])
def test_long_runs(spark, lengths):
    songs = [["a"] * n + ["b"] for n in lengths]
    runs = S.run_lengths(make(spark, songs, 6))
    exact = S.repeat_histogram(runs).where("label = 'a'").collect()
    assert {r.length: r.n for r in exact} == dict(Counter(lengths))
    capped = S.repeat_histogram(runs, cap="reference").where("label = 'a'").collect()
    want = windows([x for song in songs for x in song])
    assert {r.length: r.n for r in capped} == want


def test_ignored_label_is_not_bridged(spark):
    found = counts(S.transitions(make(spark, [["a", "\r", "b", "a"]])))
    assert found == {(START, "a"): 1, ("b", "a"): 1, ("a", END): 1}


def test_boundary_modes(spark):
    songs = [["a", "a"], ["a", "b"]]
    whole = P.phenotype(make(spark, songs), PhenotypeParams(boundary="subject")).first()
    split = P.phenotype(make(spark, songs)).first()
    assert whole.n_songs == 1 and split.n_songs == 2
    assert whole.intro_labels == ["a"]


def test_noise_is_a_label_unless_dropped(spark):
    segs = spark.createDataFrame([("x", 0), ("y", 1)], "segment_id string, pos int").withColumn(
        "label", F.lit("m"))
    labels = spark.createDataFrame([("x", 4)], "segment_id string, label int")
    kept = {r.segment_id: r.label for r in S.build_sequence(segs, labels, "auto").collect()}
    assert kept == {"x": "4", "y": "-1"}
    assert S.build_sequence(segs, labels, "auto", "drop").count() == 1


def test_split_songs_keeps_complete_spans(spark):
    stream = ["a", START, "b", "c", START, "d", END, "e", START, END, START, "f"]
    df = spark.createDataFrame(list(enumerate(stream)), "ord int, label string").select(
        F.lit("b").alias("subject"), F.floor(F.col("ord") / 3).alias("chunk"), "ord", "label"
    )
    found = [(r.song_no, r.label) for r in S.split_songs(df).orderBy("ord").collect()]
    assert found == [(1, "d")]


def test_matrix_powers(spark):
    import numpy as np

    rng = random.Random(3)
    songs = [[rng.choice("abc") for _ in range(9)] for _ in range(6)]
    cells = S.transition_matrix(S.transitions(make(spark, songs))).collect()
    n = 1 + max(r["row"] for r in cells)
    p = {k: np.zeros((n, n)) for k in ("p1", "p2", "p3")}
    for r in cells:
        for k in p:
            p[k][r["row"], r["col"]] = r[k]
    assert np.allclose(p["p2"], p["p1"] @ p["p1"]) and np.allclose(p["p3"], p["p2"] @ p["p1"])
    order = spark.createDataFrame([("b", "c", 1), ("b", "a", 2), ("b", "b", 3)],
                                  "subject string, label string, label_rank int")
    ranked = S.transition_matrix(S.transitions(make(spark, songs)), order=order)
    axis = [r["from"] for r in ranked.where("col = 0").orderBy("row").collect()]
    assert axis == [START, "c", "a", "b", END]


def test_params_are_checked():
    with pytest.raises(ValueError):
        PhenotypeParams(boundary="bird")
    with pytest.raises(ValueError):
        PhenotypeParams(min_repeat=1)
    assert math.isclose(PhenotypeParams().repeat_significance, 0.4)


def test_a_chunk_is_sorted_once(spark, monkeypatch):
    written = []

    def cut(df, name="step"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        written.append((name, plan.count("Sort ["), plan.count("Aggregate(")))
        return keep(df, name)

    keep = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", cut)
    songs = [list("aabbbac"), list("c"), list("caab")]
    for size in (1, 2, 3, 100):
        joined = [[x for song in songs for x in song]]
        got = counts(S.transitions(make(spark, songs, size), "subject"))
        assert got == expected_counts(joined)
        assert counts(S.transitions(make(spark, songs, size))) == expected_counts(songs)
    assert set(written) == {("runs", 1, 0)}
