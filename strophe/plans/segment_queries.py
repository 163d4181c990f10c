"""Intervals, file names and stored tables, bound to events, orders, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.scalars import round_all
from strophe.operators import segments as G
from strophe.plans.bindings import r6, sql
from strophe.plans.registry import query, table
from strophe.session import cut_lineage, scratch_path
from strophe.sources import ingest as I
from strophe.sources import names as N
from strophe.sources import stages as T

HOUR = 3_600_000.0


def segments(spark, sf_dir):
    """An event lasts its value in minutes or until the next one; a user's week is a song."""
    events = table(spark, sf_dir, "events")
    ms = (
        (F.weekday("ts") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60) * 1000.0
        + F.expr("extract(SECOND FROM ts)").cast("double") * 1000.0
    )
    rows = events.select(
        F.col("user_id").alias("subject"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("song_id"),
        "event_id",
        F.round(ms, 3).alias("onset"),
        F.col("event_type").alias("label"),
        "value",
    )
    starts = rows.withColumns({"offset": F.col("onset"), "pos": F.col("event_id")})
    spaced = G.gaps(starts, F.floor(F.col("onset") / HOUR))
    ends = F.least(F.col("onset") + F.col("value") * 60000.0,
                   F.coalesce(F.col("onset") + F.col("next_gap"), F.lit(float("inf"))))
    from strophe.operators.sequences import with_positions

    keyed = spaced.withColumns(
        {"offset": F.round(ends, 3), "ord": F.col("event_id"), "song_at": F.col("song_id"),
         "chunk": F.floor(F.col("onset") / HOUR)}
    ).drop("pos", "prev_gap", "next_gap")
    return with_positions(keyed).drop("ord", "song_at", "chunk", "value")


SEG_SQL = """
raw AS (SELECT user_id AS subject, strftime(date_trunc('week', ts), '%Y-%m-%d') AS song_id,
  event_id, event_type AS label, value,
  round((epoch_us(ts) - epoch_us(date_trunc('week', ts))) / 1000.0::DOUBLE, 3) AS onset FROM events),
seg AS (SELECT subject, song_id, event_id, label, onset,
  round(least(onset + value * 60000.0::DOUBLE,
              coalesce(lead(onset) OVER w, 'infinity'::DOUBLE)), 3) AS "offset",
  row_number() OVER w - 1 AS pos FROM raw
  WINDOW w AS (PARTITION BY subject, song_id ORDER BY onset, event_id)),
span AS (SELECT subject, song_id, min(onset) AS first_onset, arg_max("offset", onset) AS last_offset,
  count(*) AS n FROM seg GROUP BY subject, song_id)
"""


@query("segments", sql(SEG_SQL, f"SELECT subject, song_id, event_id, label, pos, {r6('onset', digits=3)}, {r6('\"offset\"', '\"offset\"', 3)} FROM seg"))
def segment_table(spark, sf_dir):
    return round_all(segments(spark, sf_dir), ["onset", "offset"], 3)


@query(
    "shift_times",
    sql(SEG_SQL, f"SELECT event_id, {r6('onset + 8', 'onset', 3)} FROM seg"),
)
def shift_times(spark, sf_dir):
    out = G.shift_times(segments(spark, sf_dir), G.format_offset_ms(32000.0))
    return round_all(out.select("event_id", "onset"), ["onset"], 3)


@query("drop_long", sql(SEG_SQL, 'SELECT event_id, pos FROM seg WHERE "offset" - onset <= 3600000'))
def drop_long(spark, sf_dir):
    return G.drop_long(segments(spark, sf_dir), HOUR).select("event_id", "pos")


@query(
    "split_long",
    sql(SEG_SQL, f"""d AS (SELECT *, "offset" - onset AS size,
          floor(("offset" - onset) / 1800000)::BIGINT AS w FROM seg),
        p AS (SELECT *, unnest(range(CASE WHEN size <= 1800000 THEN 1
               ELSE w + CASE WHEN size - w * 1800000 > 0 THEN 1 ELSE 0 END END)) AS piece FROM d)""",
        f"""SELECT event_id, piece, {r6('onset + piece * 1800000', 'onset', 3)},
        {r6('least(onset + (piece + 1) * 1800000, "offset")', '"offset"', 3)} FROM p"""),
)
def split_long(spark, sf_dir):
    out = G.split_long(segments(spark, sf_dir), HOUR / 2)
    out = out.select("event_id", F.col("piece").cast("long").alias("piece"), "onset", "offset")
    return round_all(out, ["onset", "offset"], 3)


SLICE_SQL = """
sl AS (SELECT subject, song_id, first_onset, last_offset,
  unnest(range(ceil((last_offset - first_onset) / 3600000)::BIGINT)) AS slice FROM span
  WHERE last_offset > first_onset),
bins AS (SELECT *, first_onset + slice * 3600000.0::DOUBLE AS b FROM sl),
hit AS (SELECT bins.subject, bins.song_id, slice, label, pos FROM bins JOIN seg
  ON seg.subject = bins.subject AND seg.song_id = bins.song_id
  AND ((b >= onset AND b < "offset") OR (b < onset AND b + 3600000 > onset))),
lst AS (SELECT subject, song_id, slice, max(pos) AS pos, arg_max(label, pos) AS label FROM hit
  GROUP BY ALL),
lab AS (SELECT l.subject, l.song_id, l.slice, coalesce(h.label, '') || l.label AS label FROM lst l
  LEFT JOIN hit h ON h.subject = l.subject AND h.song_id = l.song_id AND h.slice = l.slice
  AND h.pos = l.pos - 1)
"""


@query(
    "make_slices",
    sql(SEG_SQL, SLICE_SQL, f"SELECT subject, song_id, slice, {r6('b', 'slice_onset', 3)} FROM bins"),
)
def make_slices(spark, sf_dir):
    out = G.make_slices(segments(spark, sf_dir), HOUR).select(
        "subject", "song_id", F.col("slice").cast("long").alias("slice"), "slice_onset"
    )
    return round_all(out, ["slice_onset"], 3)


@query(
    "label_slices",
    sql(SEG_SQL, SLICE_SQL, """SELECT bins.subject, bins.song_id, bins.slice,
        coalesce(lab.label, 'gap') AS label FROM bins LEFT JOIN lab ON lab.subject = bins.subject
        AND lab.song_id = bins.song_id AND lab.slice = bins.slice"""),
)
def label_slices(spark, sf_dir):
    return G.label_slices(segments(spark, sf_dir), HOUR).select(
        "subject", "song_id", F.col("slice").cast("long").alias("slice"), "label"
    )


@query(
    "slice_summary",
    sql(SEG_SQL, SLICE_SQL, f"""SELECT coalesce(lab.label, 'gap') AS label, count(*) AS n,
        {r6('avg(3600000)', 'mean_width', 3)},
        {r6('''avg(CASE WHEN first_onset + (bins.slice + 1) * 3600000 < last_offset
               THEN 0 END)''', 'mean_pause', 3)}
        FROM bins LEFT JOIN lab ON lab.subject = bins.subject AND lab.song_id = bins.song_id
        AND lab.slice = bins.slice GROUP BY 1"""),
)
def slice_summary(spark, sf_dir):
    out = G.slice_summary(G.label_slices(segments(spark, sf_dir), HOUR, neighbours=True))
    return round_all(out, ["mean_width", "mean_pause"], 3)


@query(
    "gaps",
    sql(SEG_SQL, f"""SELECT event_id,
        {r6('onset - lag("offset") OVER w', 'prev_gap', 3)},
        {r6('lead(onset) OVER w - "offset"', 'next_gap', 3)} FROM seg
        WINDOW w AS (PARTITION BY subject, song_id ORDER BY onset, pos)"""),
)
def gaps(spark, sf_dir):
    out = G.gaps(segments(spark, sf_dir), F.floor(F.col("onset") / HOUR))
    return round_all(out.select("event_id", "prev_gap", "next_gap"), ["prev_gap", "next_gap"], 3)


@query(
    "song_context",
    sql(SEG_SQL, f"""SELECT event_id, pos, {r6('"offset" - onset', 'duration_ms', 3)},
        count(*) OVER (PARTITION BY subject, song_id) AS song_length FROM seg"""),
)
def song_context(spark, sf_dir):
    out = G.song_context(segments(spark, sf_dir))
    return round_all(out.select("event_id", "pos", "duration_ms", "song_length"), ["duration_ms"], 3)


@query(
    "segment_ids",
    sql(SEG_SQL, "SELECT event_id, sha256(song_id || '_' || pos) AS segment_id FROM seg"),
)
def segment_ids(spark, sf_dir):
    return G.segment_ids(segments(spark, sf_dir)).select("event_id", "segment_id")


@query(
    "durations",
    sql(SEG_SQL, f"""SELECT event_id, {r6('("offset" - onset) / 1000', 'duration_s')} FROM seg"""),
)
def durations(spark, sf_dir):
    out = G.durations(segments(spark, sf_dir)).select("event_id", "duration_s")
    return round_all(out, ["duration_s"])


@query(
    "window_clip",
    sql(SEG_SQL, """SELECT event_id FROM seg JOIN span USING (subject, song_id)
        WHERE onset >= greatest(first_onset - 250, 0)
        AND "offset" <= least(greatest(first_onset - 250, 0) + 172800000, 432000000)"""),
)
def window_clip(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("audio_ms", F.lit(432_000_000.0))
    return G.window_clip(rows, 172_800).select("event_id")


QUOTA_SQL = """
songs AS (SELECT DISTINCT subject, song_id FROM seg),
fin AS (SELECT subject, song_id FROM seg WHERE label = 'error' GROUP BY ALL HAVING count(*) >= 4),
todo AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY sha256(song_id || '_42'),
           song_id) AS r FROM songs
         WHERE NOT EXISTS (SELECT 1 FROM fin WHERE fin.subject = songs.subject
                           AND fin.song_id = songs.song_id)),
pick AS (SELECT subject, song_id FROM todo WHERE r <= 2 - (SELECT count(*) FROM fin
           WHERE fin.subject = todo.subject))
"""


def finished(segs):
    return segs.where(F.col("label") == "error").groupBy("subject", "song_id").agg(
        F.count("*").alias("n")
    ).where("n >= 4").drop("n")


@query(
    "slice_dataset",
    sql(SEG_SQL, SLICE_SQL, QUOTA_SQL, """SELECT lab.subject, lab.song_id, lab.slice, lab.label,
        sha256(lab.song_id || '_' || lab.slice) AS segment_id FROM lab
        JOIN pick ON pick.subject = lab.subject AND pick.song_id = lab.song_id
        JOIN bins ON bins.subject = lab.subject AND bins.song_id = lab.song_id
          AND bins.slice = lab.slice"""),
)
def slice_dataset(spark, sf_dir):
    segs = segments(spark, sf_dir)
    out = G.slice_dataset(segs, HOUR, 2, finished(segs))
    return out.select("subject", "song_id", F.col("slice").cast("long").alias("slice"), "label",
                      "segment_id")


# ---- names and listings -----------------------------------------------------------------------

NAME_SQL = """
nm AS (SELECT event_id, event_type AS k, user_id AS u, ts,
  'r' || user_id || 'w' || (user_id % 10) AS raw, 'rd' || user_id || 'wh' || (user_id % 10) AS good,
  strftime(ts, '%Y%m%d') AS ymd, strftime(ts, '%H%M%S') AS hms FROM events)
"""


def named(spark, sf_dir):
    u = F.col("user_id").cast("string")
    raw = F.concat(F.lit("r"), u, F.lit("w"), (F.col("user_id") % 10).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("k"), raw.alias("raw"),
        F.date_format("ts", "yyyyMMdd").alias("ymd"), F.date_format("ts", "HHmmss").alias("hms"),
        F.date_format("ts", "ddMMyy").alias("dmy"), "ts", "value",
    )


@query(
    "parse_recording_name",
    sql(NAME_SQL, """SELECT event_id, CASE k WHEN 'purchase' THEN NULL ELSE good END AS subject,
        CASE k WHEN 'purchase' THEN NULL ELSE ymd END AS day,
        CASE k WHEN 'view' THEN lpad((event_id % 5000)::VARCHAR, 6, '0')
          WHEN 'purchase' THEN NULL WHEN 'signup' THEN hms ELSE hms END AS time,
        k <> 'purchase' AS success FROM nm"""),
)
def parse_recording_name(spark, sf_dir):
    rows = named(spark, sf_dir)
    count = (F.col("event_id") % 5000).cast("string")
    path = (
        F.when(F.col("k") == "click",
               F.concat_ws("_", "raw", F.substring("ymd", 3, 6), F.concat("hms", F.lit(".wav"))))
        .when(F.col("k") == "view", F.concat("raw", F.lit("."), "ymd", F.lit("-"), count, F.lit(".wav")))
        .when(F.col("k") == "signup", F.concat("raw", F.lit("_"), "ymd", "hms", F.lit(".wav")))
        .when(F.col("k") == "error",
              F.concat_ws("_", "raw", F.lit("x"), "ymd", F.concat("hms", F.lit(".wav.not.mat"))))
        .otherwise(F.concat("raw", F.lit("+"), "ymd"))
    )
    out = N.parse_recording_name(rows.withColumn("path", F.concat(F.lit("/a/b/"), path)), "path")
    return out.select("event_id", "subject", "day", "time", "success")


@query(
    "parse_timestamp",
    sql(NAME_SQL, """SELECT event_id, CASE k WHEN 'signup' THEN NULL
          ELSE date_trunc('second', ts) END AS recorded_at FROM nm"""),
)
def parse_timestamp(spark, sf_dir):
    rows = named(spark, sf_dir)
    late = F.concat((F.substring("hms", 1, 2).cast("int") + 24).cast("string"),
                    F.substring("hms", 3, 4))
    name = (
        F.when(F.col("k") == "click", F.concat_ws("_", "raw", "ymd", "hms"))
        .when(F.col("k") == "view", F.concat_ws("_", "raw", "dmy", "hms"))
        .when(F.col("k") == "purchase", F.concat_ws("_", "dmy", "hms", "raw"))
        .when(F.col("k") == "error", F.concat("raw", F.lit("_"), "ymd", F.lit("-"), late))
        .otherwise(F.col("raw"))
    )
    return N.parse_timestamp(rows.withColumn("name", name), "name").select("event_id", "recorded_at")


@query(
    "order_songs",
    sql(NAME_SQL, """t AS (SELECT u AS subject, event_id, CASE WHEN k <> 'signup'
          THEN date_trunc('second', ts) END AS rec_at, event_id::VARCHAR AS song_id FROM nm)""",
        """SELECT subject, event_id, song_no FROM (SELECT *, row_number() OVER (PARTITION BY subject
           ORDER BY rec_at NULLS LAST, song_id) AS song_no FROM t) x WHERE song_no <= 30"""),
)
def order_songs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), "event_id",
        F.col("event_id").cast("string").alias("song_id"),
        F.when(F.col("event_type") != "signup", F.date_trunc("second", "ts")).alias("recorded_at"),
    )
    return I.order_songs(rows, 30).select("subject", "event_id", "song_no")


FILE_SQL = NAME_SQL + """,
fl AS (SELECT *, '/data/' || raw || '/' || (CASE WHEN k = 'view' THEN 'b/' ELSE '' END) || ymd
         || '/' || raw || '_' || substr(ymd, 3) || '_' || event_id AS stem FROM nm),
aud AS (SELECT * FROM fl WHERE k <> 'error')
"""


def files(spark, sf_dir):
    rows = named(spark, sf_dir)
    extra = F.when(F.col("k") == "view", "b/").otherwise("")
    stem = F.concat(
        F.lit("/data/"), "raw", F.lit("/"), extra, "ymd", F.lit("/"), "raw", F.lit("_"),
        F.substring("ymd", 3, 6), F.lit("_"), F.col("event_id").cast("string"),
    )
    rows = rows.withColumn("stem", stem)
    notes = rows.select(F.concat("stem", F.lit(".wav.not.mat")).alias("path"))
    audio = rows.where("k <> 'error'").select(F.concat("stem", F.lit(".wav")).alias("path"))
    return notes.unionByName(audio), rows


@query(
    "list_songs",
    sql(FILE_SQL, """SELECT good AS subject, stem || '.wav.not.mat' AS annotation,
                            stem || '.wav' AS audio FROM aud"""),
)
def list_songs(spark, sf_dir):
    return I.list_songs(files(spark, sf_dir)[0])


@query(
    "list_songs_batches",
    sql(FILE_SQL, """b AS (SELECT good, ymd, stem, regexp_replace(stem, '/[^/]*$', '') AS folder
          FROM aud WHERE k <> 'click'),
        top AS (SELECT good, ymd, max(folder) AS folder FROM b GROUP BY ALL)""",
        """SELECT b.good AS subject, stem || '.wav.not.mat' AS annotation, stem || '.wav' AS audio
           FROM b JOIN top ON top.good = b.good AND top.ymd = b.ymd AND top.folder = b.folder"""),
)
def list_songs_batches(spark, sf_dir):
    paths, rows = files(spark, sf_dir)
    listed = rows.where("k <> 'error' AND k <> 'click'").select(
        F.regexp_replace("stem", r"/[^/]*$", "").alias("folder"),
        F.concat(N.file_name(F.col("stem")), F.lit(".wav")).alias("name"),
    )
    return I.list_songs(paths, batches=listed)


@query(
    "list_songs_metadata",
    sql(NAME_SQL, """SELECT good AS subject, '/meta/' || raw || '/Song/' || event_id ||
        '.wav.not.mat' AS annotation, NULL::VARCHAR AS audio FROM nm WHERE k <> 'view'"""),
)
def list_songs_metadata(spark, sf_dir):
    kind = F.when(F.col("k") == "view", "Call").otherwise("Song")
    paths = named(spark, sf_dir).select(
        F.concat(F.lit("/meta/"), "raw", F.lit("/"), kind, F.lit("/"),
                 F.col("event_id").cast("string"), F.lit(".wav.not.mat")).alias("path")
    )
    return I.list_songs(paths, "metadata")


@query(
    "pair_files",
    """SELECT event_id::VARCHAR AS base, '/m/' || event_id || '.x.mat' AS annotation,
       CASE WHEN value > 50 THEN '/b/' ELSE '/a/' END || event_id || '.wav' AS audio
       FROM events WHERE value > 20""",
)
def pair_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("i"), "value")
    notes = e.select(F.concat(F.lit("/m/"), "i", F.lit(".x.mat")).alias("path"))
    near = e.where("value > 20").select(F.concat(F.lit("/a/"), "i", F.lit(".wav")).alias("path"))
    far = e.where("value > 50").select(F.concat(F.lit("/b/"), "i", F.lit(".wav")).alias("path"))
    return I.pair_files(notes, near.unionByName(far))


@query(
    "skip_processed",
    sql(SEG_SQL, QUOTA_SQL, "SELECT subject, song_id FROM todo"),
)
def skip_processed(spark, sf_dir):
    segs = segments(spark, sf_dir)
    songs = segs.select("subject", "song_id").distinct()
    return I.skip_processed(songs, finished(segs), ["subject", "song_id"])


@query(
    "sample_songs",
    sql(SEG_SQL, QUOTA_SQL, "SELECT subject, song_id FROM pick"),
)
def sample_songs(spark, sf_dir):
    segs = segments(spark, sf_dir)
    done = finished(segs)
    todo = I.skip_processed(segs.select("subject", "song_id").distinct(), done,
                            ["subject", "song_id"])
    return I.sample_songs(todo, 2, done=done)


@query(
    "validate_annotations",
    """SELECT vec_id AS song_id, CASE WHEN label = 7 THEN 'missing: labels'
         WHEN label = 3 THEN 'length mismatch' WHEN embedding[5] <= 0 THEN 'offset <= onset' END
         AS error, label NOT IN (3, 7) AND embedding[5] > 0 AS is_song FROM embeddings""",
)
def validate_annotations(spark, sf_dir):
    return I.validate_annotations(annotations(spark, sf_dir)).select("song_id", "error", "is_song")


def annotations(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "onsets", F.slice(F.col("embedding").cast("array<double>"), 1, 4)
    )
    shift = F.col("embedding")[4].cast("double")
    return rows.select(
        F.col("vec_id").alias("song_id"), F.col("label").alias("subject"), "onsets",
        F.transform("onsets", lambda x: x + shift).alias("offsets"),
        F.when(F.col("label") != 7, F.array_repeat(
            F.lit("a"), F.when(F.col("label") == 3, 3).otherwise(4))).alias("labels"),
    )


@query(
    "explode_annotations",
    f"""SELECT vec_id AS song_id, i - 1 AS pos, {r6('embedding[i]', 'onset')},
          {r6('embedding[i]::DOUBLE + embedding[5]::DOUBLE', '"offset"')}, 'a' AS label
        FROM embeddings, range(1, 5) r(i) WHERE label NOT IN (3, 7) AND embedding[5] > 0""",
)
def explode_annotations(spark, sf_dir):
    rows = I.validate_annotations(annotations(spark, sf_dir))
    out = I.explode_annotations(rows, ["song_id"]).withColumn("pos", F.col("pos").cast("long"))
    return round_all(out, ["onset", "offset"])


STATUS_SQL = """
st AS (SELECT subject, song_id, max("offset") - min(onset) AS span_ms, count(*) AS n_segments,
  CASE WHEN count(*) <= 1 THEN 'single segment'
       WHEN max("offset") - min(onset) <= 345600000 THEN 'too short' END AS reason
  FROM seg GROUP BY subject, song_id)
"""


@query(
    "song_status",
    sql(SEG_SQL, STATUS_SQL, f"""SELECT subject, song_id, n_segments, reason,
        CASE WHEN reason IS NULL THEN 'processed' ELSE 'skipped' END AS status,
        {r6('span_ms', digits=3)} FROM st"""),
)
def song_status(spark, sf_dir):
    return round_all(I.song_status(segments(spark, sf_dir), 345_600_000), ["span_ms"], 3)


@query(
    "filter_songs",
    sql(SEG_SQL, STATUS_SQL, """SELECT event_id FROM seg JOIN st USING (subject, song_id)
                                WHERE reason IS NULL"""),
)
def filter_songs(spark, sf_dir):
    return I.filter_songs(segments(spark, sf_dir), 345_600_000).select("event_id")


@query(
    "ingest_report",
    sql(SEG_SQL, STATUS_SQL, """SELECT subject, count(*) FILTER (reason IS NULL) AS processed,
        count(*) FILTER (reason IS NOT NULL) AS skipped, 0::BIGINT AS failed FROM st
        GROUP BY subject"""),
)
def ingest_report(spark, sf_dir):
    return I.ingest_report(I.song_status(segments(spark, sf_dir), 345_600_000))


PART_NAME_SQL = """
pn AS (SELECT p_partkey, upper(substr(p_name, 1, 1)) || p_size || substr(split_part(p_name, ' ', 2),
         1, 1) || (p_partkey % 9) || CASE WHEN p_size > 40 THEN 's' ELSE '' END AS name FROM part)
"""


def part_names(spark, sf_dir):
    word = F.element_at(F.split("p_name", " "), 2)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(
            F.upper(F.substring("p_name", 1, 1)), F.col("p_size").cast("string"),
            F.substring(word, 1, 1), (F.col("p_partkey") % 9).cast("string"),
            F.when(F.col("p_size") > 40, "s").otherwise(""),
        ).alias("name"),
    )


def _case(text: str, entries: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in entries.items())
    return f"CASE {text} {whens} ELSE {text} END"


@query(
    "normalize_subject",
    sql(PART_NAME_SQL, f"""SELECT p_partkey, CASE WHEN regexp_full_match(lower(name),
          '([a-z]+[0-9]+)+') THEN array_to_string(list_transform(
          regexp_extract_all(lower(name), '[a-z]+[0-9]+'), lambda t:
          {_case("regexp_extract(t, '[a-z]+')", N.COLOUR_CODES)} || regexp_extract(t, '[0-9]+')), '')
          ELSE lower(name) END AS subject FROM pn"""),
)
def normalize_subject(spark, sf_dir):
    return part_names(spark, sf_dir).select(
        "p_partkey", N.normalize_subject(F.col("name")).alias("subject")
    )


BAND_CASE = "CASE " + " ".join(
    [f"WHEN c = '{k}' THEN '{v}'" for k, v in {**N.BAND_NAMES, **N.BAND_LETTERS}.items()]
    + [f"WHEN c = '{v}' THEN '{v}'" for v in sorted({*N.BAND_NAMES.values(),
                                                    *N.BAND_LETTERS.values()})]
    + [f"WHEN starts_with('{k}', c) THEN '{v}'" for k, v in N.BAND_NAMES.items()]
) + " ELSE c END"


@query(
    "standardize_band",
    f"""WITH b AS (SELECT p_partkey, lower(trim(split_part(p_name, ' ', 1) || p_size ||
          CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'W' || p_partkey WHEN 2 THEN 'gre'
          ELSE '-' || p_partkey || 'x' || p_size END)) AS band FROM part),
        t AS (SELECT p_partkey, list_transform(regexp_extract_all(band, '[a-z]+'),
                lambda c: {BAND_CASE}) AS cs, regexp_extract_all(band, '[0-9]+') AS ns FROM b)
        SELECT p_partkey, CASE WHEN len(cs) BETWEEN 1 AND 2 AND len(ns) BETWEEN 1 AND 2 THEN
          cs[1] || ns[1] || coalesce(cs[2], '') || coalesce(ns[2], '') END AS band FROM t""",
)
def standardize_band(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    tail = (
        F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("W"), key)).when(kind == 2, "gre")
        .otherwise(F.concat(F.lit("-"), key, F.lit("x"), F.col("p_size").cast("string")))
    )
    band = F.concat(F.element_at(F.split("p_name", " "), 1), F.col("p_size").cast("string"), tail)
    return table(spark, sf_dir, "part").select(
        "p_partkey", N.standardize_band(band).alias("band")
    )


@query(
    "resolve_path",
    """SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url WHEN page_id % 2 > 0 THEN 's:' || url END
       AS path FROM pages""",
)
def resolve_path(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, "NONE").otherwise(F.col("url")).alias("local_path"),
        F.when(F.col("page_id") % 2 == 0, "NONE").otherwise(F.concat(F.lit("s:"), "url"))
        .alias("server_path"),
    )
    return T.resolve_path(T.null_paths(rows)).select("page_id", "path")


@query(
    "upsert_paths",
    """SELECT user_id::VARCHAR AS name,
         coalesce(arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error'), 'old')
           AS local_path,
         arg_max(props, (ts, event_id)) FILTER (event_type = 'error') AS server_path
       FROM events GROUP BY user_id""",
)
def upsert_paths(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = F.col("user_id").cast("string").alias("name")
    old = events.select(name).distinct().select(
        "name", F.lit("old").alias("local_path"), F.lit(None).cast("string").alias("server_path")
    )
    kind = F.col("event_type")
    new = events.select(
        name, F.when(kind != "error", kind).alias("local_path"),
        F.when(kind == "error", F.col("props")).alias("server_path"), F.col("ts").alias("updated"),
    )
    return T.upsert_paths(old, new)


@query("write_stage", sql(SEG_SQL, "SELECT subject, song_id, event_id, label FROM seg"))
def write_stage(spark, sf_dir):
    root = scratch_path(spark, "stage")
    rows = segments(spark, sf_dir).select("subject", "song_id", "event_id", "label")
    rows = cut_lineage(rows, "segments")  # stored three times, made once
    T.write_stage(rows.where("label <> 'error' OR subject > 20"), root, "r1", "segments")
    T.write_stage(rows, root, "r1", "segments", overwrite=True)
    T.write_stage(rows, root, "r1", "segments", key=["event_id"])
    out = T.read_stage(spark, root, "r1", "segments")
    return out.select(F.col("subject").cast("long").alias("subject"), "song_id", "event_id", "label")


@query(
    "export_csv",
    "SELECT event_type, count(*) AS n, '[\"' || event_type || '\"]' AS tags FROM events GROUP BY ALL",
)
def export_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n")
    )
    T.export_csv(counts.withColumn("tags", F.array("event_type")), path)
    return spark.read.csv(path, header=True,
                          schema="event_type string, n long, tags string")


@query(
    "run_ids",
    """SELECT o_orderkey, substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":"' ||
       o_orderstatus || '"}'), 1, 8) AS run_id FROM orders""",
)
def run_ids(spark, sf_dir):
    return T.run_ids(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"]).select(
        "o_orderkey", "run_id"
    )


RUN_SQL = """
r AS (SELECT o_custkey::VARCHAR AS run_id, o_orderdate AS created_at,
  '["s' || (o_orderkey % 7) || '","s' || (o_orderkey % 11) || '"]' AS subjects,
  '{"status":"' || o_orderstatus || '"}' AS params, o_orderkey, o_orderpriority LIKE '1%' AS fresh
  FROM orders),
old AS (SELECT * FROM r WHERE NOT fresh QUALIFY row_number() OVER (PARTITION BY run_id
          ORDER BY created_at DESC, o_orderkey DESC) = 1),
new AS (SELECT * FROM r WHERE fresh QUALIFY row_number() OVER (PARTITION BY run_id
          ORDER BY created_at DESC, o_orderkey DESC) = 1),
reg AS (SELECT * FROM new UNION ALL SELECT * FROM old
        WHERE run_id NOT IN (SELECT run_id FROM new))
"""


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = [F.concat(F.lit('"s'), (F.col("o_orderkey") % m).cast("string"), F.lit('"'))
            for m in (7, 11)]
    rows = o.select(
        F.col("o_custkey").cast("string").alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("["), name[0], F.lit(","), name[1], F.lit("]")).alias("subjects"),
        F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('"}')).alias("params"),
        "o_orderkey", "o_orderpriority",
    )
    fresh = F.col("o_orderpriority").startswith("1")
    columns = ["run_id", "created_at", "subjects", "params"]

    def newest(df):
        best = F.max_by(F.struct("created_at", "subjects", "params"),
                        F.struct("created_at", "o_orderkey")).alias("r")
        return df.groupBy("run_id").agg(best).select("run_id", "r.*").select(*columns)

    return T.register_run(newest(rows.where(~fresh)), newest(rows.where(fresh)))


@query("register_run", sql(RUN_SQL, "SELECT run_id, subjects, params FROM reg"))
def register_run(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", "subjects", "params")


@query(
    "query_runs",
    sql(RUN_SQL, """SELECT run_id FROM reg WHERE subjects LIKE '%"s3"%'
                    AND params LIKE '%"F"%'"""),
)
def query_runs(spark, sf_dir):
    return T.query_runs(runs(spark, sf_dir), "s3", status="F").select("run_id")


@query(
    "merge_subject_variants",
    """WITH n AS (SELECT DISTINCT 'rd' || user_id || 'wh1' AS canonical,
         CASE WHEN event_type IN ('click', 'error') AND value > 100 THEN 'r' || user_id || 'w1'
              WHEN event_type = 'view' AND value > 200 THEN 'R' || user_id || 'WH1'
              ELSE 'rd' || user_id || 'wh1' END AS name FROM events)
       SELECT canonical, string_agg(name, ',' ORDER BY name) AS names FROM n GROUP BY canonical
       HAVING count(*) > 1 OR min(name) <> canonical""",
)
def merge_subject_variants(spark, sf_dir):
    u = F.col("user_id").cast("string")
    name = (
        F.when(F.col("event_type").isin("click", "error") & (F.col("value") > 100),
               F.concat(F.lit("r"), u, F.lit("w1")))
        .when((F.col("event_type") == "view") & (F.col("value") > 200),
              F.concat(F.lit("R"), u, F.lit("WH1")))
        .otherwise(F.concat(F.lit("rd"), u, F.lit("wh1")))
    )
    out = T.merge_subject_variants(table(spark, sf_dir, "events").select(name.alias("name")))
    return out.withColumn("names", F.array_join("names", ","))


@query(
    "rank_labels_minimal",
    """SELECT event_id AS segment_id, coalesce(v.label, -1) AS label FROM events
       LEFT JOIN embeddings v ON v.vec_id = event_id""",
)
def rank_labels_minimal(spark, sf_dir):
    segs = table(spark, sf_dir, "events").select(F.col("event_id").alias("segment_id"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), "label")
    return T.rank_labels_minimal(segs, labels)


@query(
    "available_subjects",
    """SELECT DISTINCT CASE WHEN user_id < 3 THEN '_' ELSE 's' END || user_id AS subject FROM events
       WHERE user_id >= 3""",
)
def available_subjects(spark, sf_dir):
    prefix = F.when(F.col("user_id") < 3, "_").otherwise("s")
    rows = table(spark, sf_dir, "events").select(
        F.concat(prefix, F.col("user_id").cast("string")).alias("subject")
    )
    return T.available_subjects(rows)


@query("available_ranks", "SELECT DISTINCT label::INT AS rank FROM embeddings WHERE label <> 4")
def available_ranks(spark, sf_dir):
    method = F.when(F.col("label") == 4, "manual").otherwise(
        F.concat(F.lit("rank"), F.col("label").cast("string"), F.lit("_hdbscan_n5"))
    )
    return T.available_ranks(table(spark, sf_dir, "embeddings").select(method.alias("method")))


@query(
    "report_json",
    """SELECT '{"event_type":"' || event_type || '","n":' || count(*) || ',"first":' || min(event_id)
       || '}' AS report FROM events GROUP BY event_type""",
)
def report_json(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first")
    )
    path = scratch_path(spark, "report")
    T.write_report(counts, path)
    back = T.read_report(spark, path, "event_type string, n long, first long")
    return T.to_report_json(back)


@query(
    "method_id",
    """SELECT o_orderkey, replace('rank' || (o_orderkey % 5) || '_hdbscan_n' || o_custkey || '_d' ||
       CASE WHEN o_orderkey % 2 = 0 THEN '0.1' ELSE '0.05' END || '_cs5_s3_euclidean', '.', 'p')
       AS method_id FROM orders""",
)
def method_id(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 5).alias("rank"), F.lit("hdbscan").alias("method"),
        F.col("o_custkey").alias("n_neighbors"),
        F.when(F.col("o_orderkey") % 2 == 0, 0.1).otherwise(0.05).alias("min_dist"),
        F.lit(5).alias("min_cluster_size"), F.lit(3).alias("min_samples"),
        F.lit("euclidean").alias("metric"),
    )
    return T.method_id(rows).select("o_orderkey", "method_id")
