import datetime as dt

import pytest
from pyspark.sql import functions as F

from strophe.session import scratch_path
from strophe.sources import ingest as I
from strophe.sources import names as N
from strophe.sources import stages as T
from strophe.streaming import streams as ST


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_subject_names(spark):
    given = ["r25w57", "bu34o18", "pu91wt67", "y25", "n34unb", "y37s", "rd25wh57", "BU34OR18", ""]
    want = ["rd25wh57", "bu34or18", "pu91wh67", "ye25", "n34unb", "y37s", "rd25wh57", "bu34or18", ""]
    assert column(spark, given, N.normalize_subject) == want


def test_bands(spark):
    given = ["b1w22", "black12 white3", "pu4", "red5blue", "g1g2g3", "77", "blu3"]
    assert column(spark, given, N.standardize_band) == [
        "bk1wh22", "bk12wh3", "pu4", "rd5bl", None, None, "bl3"]


def test_recording_names(spark):
    given = ["/x/bk1bk3_170811_140945.wav", "bk1bk3.20081118-10.wav", "bk1bk3.20081118.wav.not.mat",
             "r1w2_20081118123456.wav", "r1w2_a_20081118_123456.wav", "r1w2_20081118_1234.wav", "odd"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, path string")
    got = [(r.subject, r.day, r.time, r.success)
           for r in N.parse_recording_name(df, "path").orderBy("i").collect()]
    assert got == [
        ("bk1bk3", "20170811", "140945", True), ("bk1bk3", "20081118", "000010", True),
        ("bk1bk3", "20081118", "000000", True), ("rd1wh2", "20081118", "123456", True),
        ("rd1wh2", "20081118", "123456", True), ("rd1wh2", "20081118", "1234", True),
        (None, None, None, False)]


def test_timestamps(spark):
    given = ["a_20081118_253070", "a_181108_120000", "a_321308_120000", "none"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, name string")
    got = [r.recorded_at for r in N.parse_timestamp(df, "name").orderBy("i").collect()]
    assert got == [dt.datetime(2008, 11, 18, 1, 30, 10), dt.datetime(2008, 11, 18, 12), None, None]
    other = N.parse_timestamp(df, "name", "yyMMdd").where("i = 1").first().recorded_at
    assert other == dt.datetime(2018, 11, 8, 12)


def test_path_map(spark, tmp_path):
    file = tmp_path / "map.txt"
    file.write_text("# name | local | server\na | /l/a | /s/a\nb | NONE | /s/b\nc | NONE | NONE\n")
    paths = T.null_paths(T.read_path_map(spark, str(file)))
    got = {r.name: r.path for r in T.resolve_path(paths).collect()}
    assert got == {"a": "/l/a", "b": "/s/b", "c": None}
    server = {r.name: r.path for r in T.resolve_path(paths, "server").collect()}
    assert server["a"] == "/s/a"


def test_listing_reads_no_contents(spark, tmp_path):
    for name in ("r1w2/20240101/x.wav", "r1w2/20240101/x.wav.not.mat", "r1w2/20240101/y.wav.not.mat"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    listed = I.list_songs(I.list_paths(spark, str(tmp_path)))
    rows = listed.collect()
    assert len(rows) == 1 and rows[0].subject == "rd1wh2" and rows[0].audio.endswith("x.wav")
    assert I.list_songs(I.list_paths(spark, str(tmp_path)), subjects=["bk1"]).count() == 0


def test_stages_skip_and_overwrite(spark):
    root = scratch_path(spark, "t")
    old = spark.createDataFrame([("a", 1)], "subject string, v int")
    both = spark.createDataFrame([("a", 2), ("b", 2)], "subject string, v int")
    T.write_stage(old, root, "r", "s")
    T.write_stage(both, root, "r", "s")
    got = {r.subject: r.v for r in T.read_stage(spark, root, "r", "s").collect()}
    assert got == {"a": 1, "b": 2}
    T.write_stage(both.where("subject = 'a'"), root, "r", "s", overwrite=True)
    got = {r.subject: r.v for r in T.read_stage(spark, root, "r", "s").collect()}
    assert got == {"a": 2, "b": 2}


def test_stages_complete_stored_subjects(spark):
    root = scratch_path(spark, "t")
    whole = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 3)], "subject string, v int")
    T.write_stage(whole.where("v = 1"), root, "r", "s", key=["v"])
    for _ in range(2):
        T.write_stage(whole, root, "r", "s", key=["v"])
    got = T.read_stage(spark, root, "r", "s").select("subject", "v").collect()
    assert sorted(map(str, got)) == sorted(map(str, whole.collect()))
    T.write_stage(whole.where("v = 1"), root, "r", "s")
    assert T.read_stage(spark, root, "r", "s").count() == 4
    # an append that stopped half-way leaves rows and no mark
    whole.where("v = 1").write.partitionBy("subject").parquet(f"{root}/r/half")
    T.write_stage(whole, root, "r", "half")
    got = T.read_stage(spark, root, "r", "half").select("subject", "v").collect()
    assert sorted(map(str, got)) == sorted(map(str, whole.collect()))


def test_run_id_ignores_speed_settings():
    assert T.run_id({"a": 1, "max_workers": 4}) == T.run_id({"a": 1})
    assert T.run_id({"a": 1}) != T.run_id({"a": 2}) and len(T.run_id({})) == 8
    assert T.ranks_of_columns(["cluster_rank2_x", "cluster_rank0_y", "rank9"]) == [0, 2]


def test_annotation_errors(spark):
    rows = [([1.0, 2.0], [1.5, 2.5], ["a", "b"]), ([1.0], [1.5], ["a"]), ([1.0], [0.5], ["a"]),
            ([1.0], [1.5, 2.0], ["a"]), (None, [1.0], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, onsets array<double>, offsets array<double>, labels array<string>")
    got = [(r.error, r.is_song) for r in I.validate_annotations(df).orderBy("i").collect()]
    assert got == [(None, True), (None, False), ("offset <= onset", False),
                   ("length mismatch", False), ("missing: onsets,labels", False)]


def test_song_order_puts_unknown_times_last(spark):
    df = spark.createDataFrame([("b", "x", None), ("b", "y", dt.datetime(2024, 1, 2)),
                                ("b", "z", dt.datetime(2024, 1, 1))],
                               "subject string, song_id string, recorded_at timestamp_ntz")
    got = {r.song_id: r.song_no for r in I.order_songs(df).collect()}
    assert got == {"z": 1, "y": 2, "x": 3}
    assert I.order_songs(df, 2).count() == 2


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_counts_equal_batch_counts(spark, sf, batches):
    from strophe.operators.sequences import transitions
    from strophe.plans.bindings import event_sequence

    rows = event_sequence(spark, sf)
    path, target = scratch_path(spark, "songs"), scratch_path(spark, "counts")
    for k in range(batches):
        rows.where(F.col("subject") % batches == k).coalesce(1).write.mode("append").parquet(path)
    source = ST.read_landing(spark, path, rows.schema, files_per_batch=1)
    state = scratch_path(spark, "state")
    ST.stream_transition_counts(source, target, state).awaitTermination()
    ST.stream_transition_counts(source, target, state).awaitTermination()

    def flat(df):
        return {(r.subject, r["from"], r.to): r.n for r in df.collect()}

    assert flat(ST.transition_totals(spark, target)) == flat(transitions(rows))


def test_stream_sessions_equal_batch_sessions(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("label"),
        F.col("ts").cast("timestamp").alias("ts"))
    path, target = scratch_path(spark, "rows"), scratch_path(spark, "sessions")
    rows.write.parquet(path)
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    end.select(F.lit(-1).cast("long").alias("subject"), F.lit("end").alias("label"), "ts").write.mode(
        "append").parquet(path)
    source = ST.read_landing(spark, path, rows.schema)
    ST.run_available(ST.stream_song_summary(source, "6 hours", "0 seconds"), target,
                     scratch_path(spark, "state")).awaitTermination()
    batch = ST.stream_song_summary(rows, "6 hours", watermark=False)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(
        map(tuple, batch.collect()))


def one_by_one(spark, rows, part, order=(3, 0, 4, 1, 2)):
    """A stream of one file per batch; ``part`` says which file holds a row."""
    path = scratch_path(spark, "files")
    for k in order:
        rows.where(F.pmod(part, F.lit(5)) == k).coalesce(1).write.mode("append").parquet(path)
    return ST.read_landing(spark, path, rows.schema, files_per_batch=1)


def late_events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("label"),
        F.col("event_id").alias("segment_id"), F.col("ts").cast("timestamp").alias("ts"))


def test_ingest_takes_late_batches(spark, sf):
    rows = late_events(spark, sf)
    twice = rows.unionByName(rows.where("label = 'click'"))
    target = scratch_path(spark, "stream")
    source = one_by_one(spark, twice, F.expr("xxhash64(segment_id, rand(7))"))
    ST.stream_ingest(source, target, scratch_path(spark, "state")).awaitTermination()
    got = ST.ingested(spark, target).select(*rows.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_sessions_take_late_batches(spark, sf):
    rows = late_events(spark, sf).drop("segment_id")
    target = scratch_path(spark, "sessions")
    source = one_by_one(spark, rows, F.xxhash64("ts"))
    ST.stream_sessions(source, target, scratch_path(spark, "state"), "6 hours").awaitTermination()
    got = ST.session_totals(spark, target, "6 hours")
    want = ST.stream_song_summary(rows, "6 hours", watermark=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("split", ["days", "rows"])
def test_transitions_of_songs_over_batches(spark, sf, split):
    from strophe.operators.sequences import transitions
    from strophe.plans.bindings import event_sequence

    rows = event_sequence(spark, sf)
    part = F.floor(F.col("chunk") / 24) if split == "days" else F.xxhash64("ord")
    target = scratch_path(spark, "counts")
    source = one_by_one(spark, rows, part)
    ST.stream_transition_counts(source, target, scratch_path(spark, "state")).awaitTermination()

    def flat(df):
        return {(r.subject, r["from"], r.to): r.n for r in df.collect()}

    assert flat(ST.transition_totals(spark, target)) == flat(transitions(rows))


def test_write_stage_query_makes_its_segments_once(spark, sf, monkeypatch):
    from strophe.plans import segment_queries as Q

    made = spark.sparkContext.accumulator(0)
    schema = "subject long, song_id string, event_id long, label string"

    def segments(spark, sf_dir):
        def note(batches):
            for pdf in batches:
                made.add(len(pdf))
                yield pdf

        rows = [(i % 2, "s", i, "view") for i in range(6)]
        return spark.createDataFrame(rows, schema).mapInPandas(note, schema)

    monkeypatch.setattr(Q, "segments", segments)
    assert Q.write_stage(spark, sf).count() == 6
    assert made.value == 6


def test_stages_have_few_files_whatever_the_subjects(spark, tmp_path):
    root, files = str(tmp_path), {}
    for n in (20, 600):
        rows = spark.range(2 * n).selectExpr(f"nullif(id % {n}, 7) AS subject", "id AS v", "0 AS made")
        T.write_stage(rows.where("v % 3 = 0"), root, "r", f"s{n}", key=["v"])
        T.write_stage(rows, root, "r", f"s{n}", key=["v"])
        T.write_stage(rows.where("subject = 1").withColumn("made", F.lit(1)), root, "r", f"s{n}", overwrite=True)
        T.write_stage(rows.withColumn("made", F.lit(2)), root, "r", f"s{n}")
        got = T.read_stage(spark, root, "r", f"s{n}").select("subject", "v", "made").collect()
        want = [(r.subject, r.v, int(r.subject == 1)) for r in rows.collect()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        files[n] = sum(1 for f in tmp_path.rglob(f"s{n}*/**/*.parquet"))
    assert files[600] <= files[20] + 4


def test_a_stage_of_no_rows_is_empty(spark, tmp_path):
    none = spark.createDataFrame([], "subject string, v int")
    for _ in range(2):
        T.write_stage(none, str(tmp_path), "r", "s")
        assert T.read_stage(spark, str(tmp_path), "r", "s").columns == ["subject", "v"]
        assert T.read_stage(spark, str(tmp_path), "r", "s").count() == 0
