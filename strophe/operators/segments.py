"""Segments: labelled time intervals inside a song, in milliseconds.

Columns ``subject, song_id, pos, onset, offset, label``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.session import cut_lineage

SONG = ["subject", "song_id"]
GAP = "gap"
#: Slices that get their labels at a time.
BLOCK = 128


def format_offset_ms(sample_rate: float | Column) -> Column:
    """Shift of one annotation format: 256 samples."""
    rate = F.lit(sample_rate) if isinstance(sample_rate, (int, float)) else sample_rate
    return 256.0 * 1000.0 / rate


def shift_times(segs: DataFrame, offset_ms: Column | float) -> DataFrame:
    shift = F.lit(offset_ms) if isinstance(offset_ms, (int, float)) else offset_ms
    return segs.withColumns(
        {"onset": F.col("onset") + shift, "offset": F.col("offset") + shift}
    )


def drop_long(segs: DataFrame, max_ms: float) -> DataFrame:
    """Segments up to ``max_ms``; ``pos`` still tells their place among all."""
    return segs.where(F.col("offset") - F.col("onset") <= max_ms)


def split_long(segs: DataFrame, max_ms: float) -> DataFrame:
    """Pieces of at most ``max_ms``; ``piece`` counts them inside the original segment."""
    size = F.col("offset") - F.col("onset")
    whole = F.floor(size / max_ms).cast("int")
    rest = size - whole * max_ms > 0
    pieces = F.when(size <= max_ms, 1).otherwise(whole + F.when(rest, 1).otherwise(0))
    out = segs.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("onset") + F.col("piece") * max_ms
    return out.withColumns(
        {"_start": start, "_end": F.least(start + max_ms, F.col("offset"))}
    ).withColumns({"onset": F.col("_start"), "offset": F.col("_end")}).drop("_start", "_end")


def song_spans(segs: DataFrame) -> DataFrame:
    """First onset and last offset of every song; combined before the shuffle."""
    return segs.groupBy(*SONG).agg(
        F.min("onset").alias("first_onset"),
        F.max_by("offset", "onset").alias("last_offset"),
        F.count("*").alias("n_segments"),
    )


def make_slices(segs: DataFrame, width_ms: float) -> DataFrame:
    """Bins of ``width_ms`` from the first onset up to the last offset of the song."""
    spans = song_spans(segs)
    count = F.ceil((F.col("last_offset") - F.col("first_onset")) / width_ms).cast("int")
    return (
        spans.where(count > 0)
        .withColumn("slice", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("slice_onset", F.col("first_onset") + F.col("slice") * width_ms)
        .withColumn("slice_offset", F.col("slice_onset") + width_ms)
        .select(*SONG, "slice", "slice_onset", "slice_offset")
    )


def _touched(segs: DataFrame, width_ms: float) -> DataFrame:
    """Every segment beside the slices it may overlap, by slice number: the bucketed equi-key."""
    spans = song_spans(segs).select(*SONG, "first_onset", "last_offset")
    first = F.floor((F.col("onset") - F.col("first_onset")) / width_ms).cast("int")
    last = F.floor((F.col("offset") - F.col("first_onset")) / width_ms).cast("int")
    rows = segs.join(spans, SONG).withColumn(
        "slice", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last + 1))
    )
    begin = F.col("first_onset") + F.col("slice") * width_ms
    inside = (begin >= F.col("onset")) & (begin < F.col("offset"))
    across = (begin < F.col("onset")) & (begin + width_ms > F.col("onset"))
    return rows.where((inside | across) & (begin < F.col("last_offset")))


def label_slices(segs: DataFrame, width_ms: float, neighbours: bool = False) -> DataFrame:
    """Slices labelled by what they overlap.

    A slice shared with the segment just before it takes both labels, joined; a slice without a
    segment is a gap. Interval overlap becomes an equality on (song, slice). Labels meet their slices
    a block at a time, so most gaps are made where they are read and never shuffled. With
    ``neighbours`` a column ``next_onset`` tells where the next slice of the song begins.
    """
    # written: spans and overlaps read the segments, which may be costly
    segs = cut_lineage(segs.select(*SONG, "pos", "onset", "offset", "label"), "segments")
    block = [*SONG, "_block"]
    touched = _touched(segs, width_ms).select(
        *SONG, "pos", "label", "slice", F.floor(F.col("slice") / BLOCK).cast("int").alias("_block")
    )
    w = W.partitionBy(*block, "slice").orderBy(F.col("pos").desc())
    top = touched.repartition(*block).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    held = top.groupBy(*block, "slice").agg(
        F.max_by("label", "pos").alias("_label"),
        F.max("pos").alias("_pos"),
        F.max(F.when(F.col("_r") == 2, F.struct("pos", "label"))).alias("_prev"),
    )
    joined = F.when(F.col("_prev.pos") == F.col("_pos") - 1, F.col("_prev.label"))
    named = F.struct("slice", F.concat(F.coalesce(joined, F.lit("")), F.col("_label")))
    held = held.groupBy(*block).agg(F.map_from_entries(F.collect_list(named)).alias("_labels"))
    count = F.ceil((F.col("last_offset") - F.col("first_onset")) / width_ms).cast("int")
    spans = song_spans(segs).withColumn("_count", count).where(F.col("_count") > 0)
    last = F.floor((F.col("_count") - 1) / BLOCK).cast("int")
    blocks = spans.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("_block") * BLOCK
    numbers = F.sequence(start, F.least(start + BLOCK, F.col("_count")) - 1)
    slices = blocks.join(held, block, "left").withColumn("slice", F.explode(numbers))
    onset = F.col("first_onset") + F.col("slice") * width_ms
    following = F.col("first_onset") + (F.col("slice") + 1) * width_ms
    return slices.select(
        *SONG, "slice",
        onset.alias("slice_onset"),
        (onset + width_ms).alias("slice_offset"),
        F.coalesce(F.try_element_at("_labels", F.col("slice")), F.lit(GAP)).alias("label"),
        *([F.when(F.col("slice") + 1 < F.col("_count"), following).alias("next_onset")]
          if neighbours else []),
    )


def slice_summary(slices: DataFrame) -> DataFrame:
    """Slices per label with mean width and mean pause before the next slice of the song.

    Slices that know the onset of the next one are counted where they are.
    """
    rows = slices.withColumnsRenamed(
        {"slice": "pos", "slice_onset": "onset", "slice_offset": "offset"}
    )
    if "next_onset" in slices.columns:
        rows = rows.withColumn("next_gap", F.col("next_onset") - F.col("offset"))
    else:
        rows = gaps(rows)
    return rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.avg(F.col("offset") - F.col("onset")).alias("mean_width"),
        F.avg("next_gap").alias("mean_pause"),
    )


def gaps(segs: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Silence before and after every segment; null at the ends of a song.

    With ``chunk``, a coarser monotone key of the onset, only the ends of chunks are ordered per
    song, so a very long song is no single task.
    """
    if chunk is None:
        chunk = F.floor(F.col("pos") / 100_000)
    segs = segs.withColumn("_chunk", chunk)
    w = W.partitionBy(*SONG, "_chunk").orderBy("onset", "pos")
    across = W.partitionBy(*SONG).orderBy("_chunk")
    ends = segs.groupBy(*SONG, "_chunk").agg(
        F.min("onset").alias("_first"),
        F.max_by("offset", F.struct("onset", "pos")).alias("_last"),
    )
    ends = ends.select(
        *SONG, "_chunk",
        F.lag("_last").over(across).alias("_before"),
        F.lead("_first").over(across).alias("_after"),
    )
    return (
        segs.withColumns({"_p": F.lag("offset").over(w), "_n": F.lead("onset").over(w)})
        .join(ends, [*SONG, "_chunk"])
        .withColumns(
            {
                "prev_gap": F.col("onset") - F.coalesce("_p", "_before"),
                "next_gap": F.coalesce("_n", "_after") - F.col("offset"),
            }
        )
        .drop("_chunk", "_p", "_n", "_before", "_after")
    )


def song_context(segs: DataFrame) -> DataFrame:
    """Duration, place in the song and number of segments of the song."""
    counts = segs.groupBy(*SONG).agg(F.count("*").alias("song_length"))
    return segs.join(counts, SONG).withColumn("duration_ms", F.col("offset") - F.col("onset"))


def segment_id(base: Column, position: Column) -> Column:
    """SHA-256 of the song id and the place in the original annotation."""
    return F.sha2(F.concat_ws("_", base.cast("string"), position.cast("string")), 256)


def segment_ids(segs: DataFrame) -> DataFrame:
    return segs.withColumn("segment_id", segment_id(F.col("song_id"), F.col("pos")))


def durations(segs: DataFrame) -> DataFrame:
    return segs.withColumn("duration_s", (F.col("offset") - F.col("onset")) / 1000.0)


def window_clip(segs: DataFrame, seconds: float, lead_s: float = 0.25) -> DataFrame:
    """Segments inside a window that opens shortly before the first onset of the song.

    Where ``audio_ms`` is given the window ends with the audio.
    """
    first = segs.groupBy(*SONG).agg(F.min("onset").alias("_first"))
    start = F.greatest(F.col("_first") - lead_s * 1000.0, F.lit(0.0))
    end = start + seconds * 1000.0
    if "audio_ms" in segs.columns:
        end = F.least(end, F.col("audio_ms"))
    return (
        segs.join(first, SONG)
        .withColumns({"window_start": start, "window_end": end})
        .where((F.col("onset") >= F.col("window_start")) & (F.col("offset") <= F.col("window_end")))
        .drop("_first")
    )


def slice_dataset(
    segs: DataFrame, width_ms: float, quota: int, done: DataFrame | None = None, seed: int = 42
) -> DataFrame:
    """Labelled slices with ids of up to ``quota`` songs per subject, finished songs counted in."""
    from strophe.sources.ingest import sample_songs, skip_processed

    songs = segs.select(*SONG).distinct()
    todo = songs if done is None else skip_processed(songs, done, SONG)
    kept = sample_songs(todo, quota, seed, done=done)
    slices = label_slices(segs.join(kept.select(*SONG), SONG, "left_semi"), width_ms)
    return slices.where(F.col("label") != GAP).withColumn(
        "segment_id", segment_id(F.col("song_id"), F.col("slice"))
    )


