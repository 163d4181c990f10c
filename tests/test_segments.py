import random

import pytest
from pyspark.sql import functions as F

from strophe.operators import segments as G


def make(spark, songs):
    rows = [("b", f"s{i}", j, float(a), float(b), lab) for i, song in enumerate(songs)
            for j, (a, b, lab) in enumerate(song)]
    return spark.createDataFrame(
        rows, "subject string, song_id string, pos long, onset double, offset double, label string")


def test_split_long(spark):
    got = G.split_long(make(spark, [[(0, 200, "a"), (300, 380, "b"), (400, 560, "c")]]), 80)
    parts = [(r.label, r.onset, r.offset) for r in got.orderBy("onset").collect()]
    assert parts == [("a", 0, 80), ("a", 80, 160), ("a", 160, 200), ("b", 300, 380),
                     ("c", 400, 480), ("c", 480, 560)]


def brute_labels(song, width):
    first, last = song[0][0], song[-1][1]
    out, start = [], first
    while start < last:
        hits = [k for k, (a, b, _) in enumerate(song)
                if a <= start < b or (start < a < start + width)]
        text = "gap"
        if hits:
            text = song[hits[-1]][2]
            if hits[-1] - 1 in hits:
                text = song[hits[-1] - 1][2] + text
        out.append(text)
        start += width
    return out


@pytest.mark.parametrize("width", [8, 16, 64])
def test_label_slices(spark, width):
    rng = random.Random(width)
    songs = []
    for _ in range(6):
        t, song = rng.randint(0, 30), []
        for _ in range(rng.randint(1, 15)):
            end = t + rng.randint(1, 40)
            song.append((t, end, rng.choice("abc")))
            t = end + rng.choice([0, 3, 50])
        songs.append(song)
    rows = G.label_slices(make(spark, songs), width).orderBy("song_id", "slice").collect()
    for i, song in enumerate(songs):
        assert [r.label for r in rows if r.song_id == f"s{i}"] == brute_labels(song, width)


@pytest.mark.parametrize("width", [10, 100, 10_000])
def test_gaps_do_not_depend_on_chunks(spark, width):
    rng = random.Random(1)
    t, song = 0, []
    for _ in range(60):
        song.append((t, t + rng.randint(1, 9), "a"))
        t = song[-1][1] + rng.randint(0, 30)
    got = G.gaps(make(spark, [song]), F.floor(F.col("onset") / width)).orderBy("onset").collect()
    for k, r in enumerate(got):
        assert r.prev_gap == (None if k == 0 else song[k][0] - song[k - 1][1])
        assert r.next_gap == (None if k == 59 else song[k + 1][0] - song[k][1])


def test_window_clip(spark):
    segs = make(spark, [[(1000, 1100, "a"), (1900, 2100, "b")]])
    assert [r.label for r in G.window_clip(segs, 1.0).collect()] == ["a"]
    assert G.window_clip(segs, 5.0).count() == 2


def test_ids_and_offset(spark):
    row = G.segment_ids(G.durations(make(spark, [[(0, 500, "a")]]))).first()
    import hashlib

    assert row.segment_id == hashlib.sha256(b"s0_0").hexdigest() and row.duration_s == 0.5
    shifted = G.shift_times(make(spark, [[(0, 5, "a")]]), G.format_offset_ms(32000.0)).first()
    assert shifted.onset == 8.0


def test_pauses_without_ordering_slices(spark):
    # 300 slices, more than two blocks of labels, and a song of one slice
    songs = [[(0, 10, "a"), (10, 25, "b"), (1290, 1300, "c"), (2980, 3000, "a")], [(7, 9, "d")]]
    segs = make(spark, songs)
    known = G.label_slices(segs, 10, neighbours=True)
    rows = known.where("song_id = 's0'").orderBy("slice").collect()
    assert [r.label for r in rows] == brute_labels(songs[0], 10) and len(rows) == 300
    assert [r.next_onset for r in rows] == [r.slice_onset for r in rows[1:]] + [None]
    found = G.slice_summary(known)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "lead(" not in plan
    expected = G.slice_summary(G.label_slices(segs, 10)).orderBy("label").collect()
    assert found.orderBy("label").collect() == expected
    # slices are no side of a join: blocks are joined first and opened after
    top = known._jdf.queryExecution().optimizedPlan().toString()
    assert top.index("Generate explode(sequence((_block") < top.index("Join LeftOuter")
