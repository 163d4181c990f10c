"""Streams over the events table, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.plans.bindings import TOKEN_SQL, event_sequence, sql
from strophe.plans.registry import query, table
from strophe.session import scratch_path
from strophe.streaming import streams as ST


def landing(spark, sf_dir):
    """The events written as Parquet files into a folder of their own."""
    path = scratch_path(spark, "landing")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("label"),
        F.col("event_id").alias("segment_id"), F.col("ts").cast("timestamp").alias("ts"),
    )
    events.unionByName(events.where("label = 'click'")).write.parquet(path)
    return ST.read_landing(spark, path, events.schema)


@query(
    "stream_ingest",
    "SELECT user_id AS subject, event_type AS label, event_id AS segment_id FROM events",
)
def stream_ingest(spark, sf_dir):
    target = scratch_path(spark, "stream")
    run = ST.stream_ingest(landing(spark, sf_dir), target, scratch_path(spark, "state"))
    run.awaitTermination()
    return ST.ingested(spark, target).select("subject", "label", "segment_id")


SESSION_SQL = """
e AS (SELECT user_id AS subject, event_type AS label, ts, ts - lag(ts) OVER (PARTITION BY user_id
        ORDER BY ts) >= INTERVAL 6 HOURS AS far FROM events),
s AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY ts) AS g
      FROM e)
"""


@query(
    "stream_song_summary",
    sql(SESSION_SQL, """SELECT subject, epoch_us(min(ts)) AS song_at, count(*) AS n,
        arg_min(label, ts) AS first_label, epoch_us(max(ts)) - epoch_us(min(ts)) AS span
        FROM s GROUP BY subject, g"""),
)
def stream_song_summary(spark, sf_dir):
    source = ST.read_landing(spark, _once(spark, sf_dir), _once_schema(spark, sf_dir))
    target = scratch_path(spark, "sessions")
    run = ST.stream_sessions(source, target, scratch_path(spark, "state"), "6 hours")
    run.awaitTermination()
    return ST.session_totals(spark, target, "6 hours").select(
        "subject", F.unix_micros("song_at").alias("song_at"), "n", "first_label",
        (F.unix_micros("last_at") - F.unix_micros("first_at")).alias("span"),
    )


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("label"),
        F.to_utc_timestamp(F.to_timestamp_ltz(F.col("ts").cast("string")), "UTC").alias("ts"),
    )


def _once_schema(spark, sf_dir):
    return _rows(spark, sf_dir).schema


def _once(spark, sf_dir):
    path = scratch_path(spark, "landing")
    _rows(spark, sf_dir).write.parquet(path)
    return path


@query(
    "stream_transition_counts",
    sql(TOKEN_SQL, 'SELECT subject, f AS "from", t AS "to", n FROM tr'),
)
def stream_transition_counts(spark, sf_dir):
    path = scratch_path(spark, "songs")
    rows = event_sequence(spark, sf_dir)
    rows.where("subject < 60").write.parquet(path)
    rows.where("subject >= 60").write.mode("append").parquet(path)
    target = scratch_path(spark, "counts")
    songs = ST.read_landing(spark, path, rows.schema)
    ST.stream_transition_counts(songs, target, scratch_path(spark, "state")).awaitTermination()
    return ST.transition_totals(spark, target)
