"""From listed files and annotations to the songs worth working on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.distributed import numbered
from strophe.operators.vectors import hash_order
from strophe.sources.names import base_name, file_name, normalize_subject

ANNOTATION = ".wav.not.mat"
SUBJECT_DIR = r"^[a-zA-Z]+\d+[a-zA-Z]*\d*\b"


def list_paths(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file under ``root``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select("path", "modificationTime", "length")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def list_songs(files: DataFrame, layout: str = "audio", kind: str = "song",
               subjects: Sequence[str] | None = None, batches: DataFrame | None = None
               ) -> DataFrame:
    """Annotation and audio paths per subject from a table of paths.

    ``audio``: annotations with their audio beside them; the subject is the first directory that
    looks like one. Where ``batches (folder, name)`` is given and not empty, only listed songs count,
    and of several folders of one subject and date the last one by path. ``metadata``: the subject
    is the parent of the annotation's folder, whose path must contain ``kind``; audio is null.
    """
    notes = files.where(F.col("path").endswith(ANNOTATION)).select(
        F.col("path").alias("annotation"), _folder(F.col("path")).alias("folder")
    )
    if layout == "metadata":
        out = notes.where(F.contains(F.lower("folder"), F.lit(kind.lower()))).select(
            normalize_subject(F.element_at(F.split("folder", "/"), -2)).alias("subject"),
            "annotation",
            F.lit(None).cast("string").alias("audio"),
        )
    elif layout == "audio":
        audio = files.where(F.col("path").endswith(".wav")).select(F.col("path").alias("audio"))
        named = notes.withColumns(
            {
                "audio": F.regexp_replace("annotation", r"\.not\.mat$", ""),
                "_dir": F.get(
                    F.filter(F.split("folder", "/"), lambda p: p.rlike(SUBJECT_DIR)), F.lit(0)
                ),
            }
        ).where(F.col("_dir").isNotNull())
        out = named.join(audio, "audio", "left_semi").withColumn(
            "subject", normalize_subject(F.col("_dir"))
        )
        if batches is not None:
            listed = batches.select("folder", F.col("name").alias("_name")).distinct()
            out = out.withColumn("_name", file_name(F.col("audio"))).join(
                listed, ["folder", "_name"], "left_semi"
            )
            out = out.withColumn("date", F.element_at(F.split("folder", "/"), -1))
            chosen = out.groupBy("subject", "date").agg(F.max("folder").alias("folder"))
            out = out.join(chosen, ["subject", "date", "folder"], "left_semi")
        out = out.select("subject", "annotation", "audio")
    else:
        raise ValueError("layout is 'audio' or 'metadata'")
    if subjects is not None:
        wanted = [str(s) for s in subjects]
        names = F.array_distinct(F.transform(F.array(*[F.lit(s) for s in wanted]),
                                             normalize_subject))
        out = out.where(F.array_contains(names, F.col("subject")))
    return out


def order_songs(df: DataFrame, first: int | None = None, by: Sequence[str] = ("subject",)
                ) -> DataFrame:
    """Songs by recording time, unknown times last; ``song_no`` counts from 1.

    With ``first`` only that many songs of every subject are kept.
    """
    order = [F.col("recorded_at").asc_nulls_last(), F.col("song_id")]
    if first is not None:
        w = W.partitionBy(*by).orderBy(*order)
        ranked = df.withColumn("song_no", F.row_number().over(w)).where(F.col("song_no") <= first)
        return ranked.withColumn("song_no", F.col("song_no").cast("long"))
    timed = df.withColumn("_at", F.unix_micros(F.col("recorded_at").cast("timestamp")))
    out = numbered(timed, by, "_at", order, "song_no")
    return out.withColumn("song_no", F.col("song_no") + 1).drop("_at")


def pair_files(annotations: DataFrame, audio: DataFrame) -> DataFrame:
    """Paths with the same name up to the first dot; the last path of a name is taken."""
    notes = annotations.groupBy(base_name(F.col("path")).alias("base")).agg(
        F.max("path").alias("annotation")
    )
    sound = audio.groupBy(base_name(F.col("path")).alias("base")).agg(
        F.max("path").alias("audio")
    )
    return notes.join(sound, "base")


def skip_processed(candidates: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(done.select(*keys).distinct(), list(keys), "left_anti")


def sample_songs(df: DataFrame, n: int, seed: int = 42, done: DataFrame | None = None
                 ) -> DataFrame:
    """Up to ``n`` songs per subject by hash order, less those already ``done``."""
    w = W.partitionBy("subject").orderBy(hash_order(F.col("song_id"), seed), "song_id")
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    if done is not None:
        saved = done.groupBy("subject").agg(F.count("*").alias("_saved"))
        ranked = ranked.join(saved, "subject", "left").where(
            F.col("_rank") <= n - F.coalesce("_saved", F.lit(0))
        ).drop("_saved")
    return ranked.drop("_rank")


def validate_annotations(df: DataFrame) -> DataFrame:
    """Reason why an annotation is unusable, null if there is none, and whether it is a song.

    ``onsets``, ``offsets`` and ``labels`` are parallel arrays; a song has more than one segment.
    """
    fields = ("onsets", "offsets", "labels")
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in fields])
    n = F.size("onsets")
    same = (n == F.size("offsets")) & (n == F.size("labels"))
    backwards = F.exists(
        F.zip_with("onsets", "offsets", lambda a, b: F.coalesce(b <= a, F.lit(True))), lambda x: x
    )
    error = (
        F.when(missing != "", F.concat(F.lit("missing: "), missing))
        .when(~same, "length mismatch")
        .when(backwards, "offset <= onset")
    )
    return df.withColumn("error", error).withColumn(
        "is_song", F.col("error").isNull() & (n > 1)
    )


def explode_annotations(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per segment of every usable annotation."""
    good = df.where(F.col("error").isNull())
    rows = good.select(*keep, F.posexplode(F.arrays_zip("onsets", "offsets", "labels")).alias(
        "pos", "_s"))
    return rows.select(
        *keep, "pos",
        F.col("_s.onsets").alias("onset"),
        F.col("_s.offsets").alias("offset"),
        F.col("_s.labels").alias("label"),
    )


def song_status(segs: DataFrame, min_span_ms: float = 2000.0) -> DataFrame:
    """Per song: processed, or skipped with the reason."""
    spans = segs.groupBy("subject", "song_id").agg(
        (F.max("offset") - F.min("onset")).alias("span_ms"), F.count("*").alias("n_segments")
    )
    reason = (
        F.when(F.col("n_segments") <= 1, "single segment")
        .when(F.col("span_ms") <= min_span_ms, "too short")
    )
    return spans.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "processed").otherwise("skipped")
    )


def filter_songs(segs: DataFrame, min_span_ms: float = 2000.0) -> DataFrame:
    """Segments of the songs that are long enough."""
    good = song_status(segs, min_span_ms).where(F.col("status") == "processed")
    return segs.join(good.select("subject", "song_id"), ["subject", "song_id"], "left_semi")


def ingest_report(status: DataFrame) -> DataFrame:
    """Songs per subject and status."""
    return status.groupBy("subject").pivot("status", ["processed", "skipped", "failed"]).agg(
        F.count(F.lit(1))
    ).na.fill(0)


def check_parallel_lengths(df: DataFrame, arrays: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose arrays have one length, and the others."""
    same = F.lit(True)
    for name in arrays[1:]:
        same = same & (F.size(name) == F.size(arrays[0]))
    same = F.coalesce(same, F.lit(False))
    return df.where(same), df.where(~same)
