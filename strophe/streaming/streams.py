"""Streaming forms: ingestion, song sessions and additive transition counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strophe.operators.sequences import transitions
from strophe.params import END, START


def read_landing(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Rows of the Parquet files that arrive in a landing folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .parquet(path)
    )


def _each_batch(rows: DataFrame, add, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ingest(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Store the rows of every batch under its number; :func:`ingested` merges them by key.

    There is no watermark, so no row is too late. A repeated batch replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _each_batch(rows, add, checkpoint)


def ingested(spark: SparkSession, target: str, key: str = "segment_id") -> DataFrame:
    """Every segment once, as the first batch that held it has it."""
    stored = spark.read.parquet(target)
    rest = F.struct(*[c for c in stored.columns if c not in (key, "batch")])
    first = stored.groupBy(key).agg(F.min_by(rest, "batch").alias("_r"))
    columns = [c if c == key else f"_r.{c}" for c in stored.columns if c != "batch"]
    return first.select(*columns)


def stream_song_summary(rows: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour",
                        at: str = "ts", watermark: bool = True) -> DataFrame:
    """Songs as sessions of a subject: count, first label and span. Works on batches too.

    In a stream, rows older than the watermark are dropped: for rows that arrive in time order.
    :func:`stream_sessions` takes rows in any order.
    """
    source = rows.withWatermark(at, lateness) if watermark else rows
    return (
        source.groupBy("subject", F.session_window(at, gap).alias("session"))
        .agg(
            F.count("*").alias("n"),
            F.min_by("label", at).alias("first_label"),
            F.min(at).alias("first_at"),
            F.max(at).alias("last_at"),
        )
        .select("subject", F.col("session.start").alias("song_at"), "n", "first_label",
                "first_at", "last_at")
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"
                  ) -> StreamingQuery:
    """Write what is there now as Parquet and stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def stream_sessions(rows: DataFrame, target: str, checkpoint: str, gap: str = "30 minutes",
                    at: str = "ts") -> StreamingQuery:
    """Store additive parts of sessions batch by batch; :func:`session_totals` merges them.

    A part holds the rows of a subject in one slot of time as long as the gap, so all of them belong
    to one session, whatever else arrives. A repeated batch replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        micros = F.unix_micros(F.col(at).cast("timestamp"))
        batch.where(F.col(at).isNotNull()).groupBy(
            "subject", (micros - F.pmod(micros, _micros(gap))).alias("slot")
        ).agg(
            F.count("*").alias("n"),
            F.min_by("label", F.struct(at, "label")).alias("first_label"),
            F.min(at).alias("first_at"),
            F.max(at).alias("last_at"),
        ).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _each_batch(rows, add, checkpoint)


def _micros(gap: str) -> Column:
    return F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}"))


def session_totals(spark: SparkSession, target: str, gap: str = "30 minutes") -> DataFrame:
    """The sessions of all batches, columns as in :func:`stream_song_summary`."""
    merged = [
        F.sum("n").alias("n"),
        F.min_by("first_label", F.struct("first_at", "first_label")).alias("first_label"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    ]
    parts = spark.read.parquet(target).groupBy("subject", "slot").agg(*merged)
    order = W.partitionBy("subject").orderBy("slot")
    # slots follow one another in time, so the one before ends last
    far = F.unix_micros(F.col("first_at").cast("timestamp")) - F.unix_micros(
        F.lag("last_at").over(order).cast("timestamp")
    ) >= _micros(gap)
    opened = parts.withColumn("_new", F.coalesce(far, F.lit(True)).cast("long"))
    numbered = opened.withColumn("_session", F.sum("_new").over(order))
    return numbered.groupBy("subject", "_session").agg(*merged).select(
        "subject", F.col("first_at").alias("song_at"), "n", "first_label", "first_at", "last_at"
    )


def stream_transition_counts(songs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Store the transitions of sequence rows batch by batch; a song may span batches.

    Each batch writes, under its own number, the counts inside its piece of every song, the first
    and last row of the piece, and its rows. A repeated batch replaces itself.
    :func:`transition_totals` stitches the pieces.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = f"{target}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(rows)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(rows)
        song = F.struct("subject", "song_id")
        stored.groupBy(song.alias("song")).agg(
            F.min("ord").alias("first"), F.min_by("label", "ord").alias("first_label"),
            F.max("ord").alias("last"), F.max_by("label", "ord").alias("last_label"),
        ).write.mode("overwrite").parquet(f"{target}/edges/batch={number}")
        inner = transitions(stored.withColumn("subject", song), ignored=())
        inner.where((F.col("from") != START) & (F.col("to") != END)).withColumnRenamed(
            "subject", "song"
        ).write.mode("overwrite").parquet(f"{target}/counts/batch={number}")

    return _each_batch(songs, add, checkpoint)


def transition_totals(spark: SparkSession, target: str,
                      ignored: Sequence[str] = ("\r",)) -> DataFrame:
    """Transitions of all batches.

    Pieces of a song that follow one another are joined at their edges. Songs whose pieces lie
    inside one another are counted from their rows.
    """
    order = W.partitionBy("song").orderBy("first", "last", "batch")
    before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    edges = spark.read.parquet(f"{target}/edges").select(
        "song", "first_label", "last_label",
        F.coalesce(F.col("first") <= before, F.lit(False)).alias("inside"),
        F.lag("last").over(order).isNull().alias("opens"),
        F.coalesce(F.lead("first_label").over(order), F.lit(END)).alias("next_label"),
    )
    mixed = edges.where("inside").select("song").distinct()
    joints = edges.join(mixed, "song", "left_anti").select(
        F.col("song.subject").alias("subject"),
        F.explode(F.filter(F.array(
            F.when(F.col("opens"), F.struct(F.lit(START).alias("from"),
                                            F.col("first_label").alias("to"))),
            F.struct(F.col("last_label").alias("from"), F.col("next_label").alias("to")),
        ), lambda pair: pair.isNotNull())).alias("_p"),
    ).select("subject", "_p.*", F.lit(1).cast("long").alias("n"))
    inner = spark.read.parquet(f"{target}/counts").join(mixed, "song", "left_anti").select(
        F.col("song.subject").alias("subject"), "from", "to", "n"
    )
    rows = spark.read.parquet(f"{target}/rows").withColumn("song", F.struct("subject", "song_id"))
    again = transitions(rows.join(mixed, "song", "left_semi").drop("song", "batch"), ignored=())
    counts = joints.unionByName(inner).unionByName(again)
    if ignored:
        counts = counts.where(~F.col("from").isin(*ignored) & ~F.col("to").isin(*ignored))
    return counts.groupBy("subject", "from", "to").agg(F.sum("n").alias("n"))
