"""Sequence phenotypes over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.scalars import round_all
from strophe.operators import phenotype as P
from strophe.operators import sequences as S
from strophe.params import PhenotypeParams
from strophe.plans import bindings as B
from strophe.plans.bindings import event_sequence, r6, sql
from strophe.plans.registry import query, table

PARAMS = PhenotypeParams(repeat_significance=B.SIGNIFICANCE, dyad_share=B.DYADS)


@query(
    "build_sequence",
    """SELECT e.user_id AS subject, e.event_id AS segment_id,
              coalesce(CAST(v.label AS VARCHAR), '-1') AS label
       FROM events e LEFT JOIN embeddings v ON v.vec_id = e.event_id""",
)
def build_sequence(spark, sf_dir):
    segs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"),
        F.col("event_id").alias("segment_id"),
        F.col("event_type").alias("label"),
    )
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), "label")
    return S.build_sequence(segs, labels, "auto").select("subject", "segment_id", "label")


@query(
    "with_boundaries",
    sql(
        B.TOKEN_SQL,
        "SELECT subject, song_id, label, pos + 1 AS place FROM tok",
    ),
)
def with_boundaries(spark, sf_dir):
    tokens = S.with_boundaries(event_sequence(spark, sf_dir)).withColumn("song_at", F.lit(0))
    keyed = tokens.withColumns(
        {"ord": F.struct("part", "ord"), "chunk": F.struct("part", "chunk")}
    )
    return S.with_positions(keyed).select("subject", "song_id", "label", F.col("pos").alias("place"))


@query(
    "with_boundaries_subject",
    sql(
        B.EVENT_SQL,
        """SELECT subject, label, count(*) AS n FROM seq GROUP BY ALL
           UNION ALL SELECT DISTINCT subject, '<start>', 1 FROM seq
           UNION ALL SELECT DISTINCT subject, '<end>', 1 FROM seq""",
    ),
)
def with_boundaries_subject(spark, sf_dir):
    tokens = S.with_boundaries(event_sequence(spark, sf_dir), "subject")
    return tokens.groupBy("subject", "label").agg(F.count("*").alias("n"))


@query(
    "split_songs",
    sql(
        B.EVENT_SQL,
        """SELECT subject, dense_rank() OVER (PARTITION BY subject ORDER BY song_id) AS song_no,
                  label, pos FROM seq""",
    ),
)
def split_songs(spark, sf_dir):
    tokens = S.with_boundaries(event_sequence(spark, sf_dir)).select(
        "subject",
        F.struct("song_id", "part", "chunk").alias("chunk"),
        F.struct("song_id", "part", "ord").alias("ord"),
        "label",
    )
    songs = S.split_songs(tokens).select(
        "subject", F.col("song_no").alias("song_id"), F.col("ord.song_id").alias("song_at"),
        ((F.unix_micros(F.col("ord.ord.k0").cast("timestamp"))) / 3_600_000_000)
        .cast("long").alias("chunk"), "ord", "label",
    )
    return S.with_positions(songs).select(
        "subject", F.col("song_id").alias("song_no"), "label", "pos"
    )


@query(
    "vocabulary",
    sql(B.TOKEN_SQL, f"""SELECT subject, label, n, {r6('proportion')},
        sum(CASE WHEN proportion > 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY subject)::BIGINT
          AS repertoire_size FROM voc"""),
)
def vocabulary(spark, sf_dir):
    vocab = S.vocabulary(S.label_counts(event_sequence(spark, sf_dir)))
    size = S.repertoire(vocab).select("subject", "repertoire_size")
    return round_all(vocab, ["proportion"]).join(size, "subject")


@query(
    "label_counts",
    sql(B.EVENT_SQL, "SELECT subject, label, count(*) AS n FROM seq GROUP BY ALL"),
)
def label_counts(spark, sf_dir):
    return S.label_counts(event_sequence(spark, sf_dir))


@query(
    "sequence_sizes",
    sql(B.EVENT_SQL, """SELECT subject, count(DISTINCT song_id) AS n_songs,
                               count(*) AS n_segments FROM seq GROUP BY ALL"""),
)
def sequence_sizes(spark, sf_dir):
    return S.sizes(event_sequence(spark, sf_dir))


@query("transitions", sql(B.TOKEN_SQL, 'SELECT subject, f AS "from", t AS "to", n FROM tr'))
def transitions(spark, sf_dir):
    return S.transitions(event_sequence(spark, sf_dir))


@query(
    "transitions_subject",
    sql(
        B.EVENT_SQL,
        """one AS (SELECT subject, label, row_number() OVER (PARTITION BY subject
                     ORDER BY song_id, pos) AS i FROM seq),
        tok AS (SELECT * FROM one UNION ALL SELECT DISTINCT subject, '<start>', 0 FROM one
                UNION ALL SELECT subject, '<end>', max(i) + 1 FROM one GROUP BY subject)""",
        """SELECT subject, f AS "from", t AS "to", count(*) AS n FROM (
             SELECT subject, label AS f, lead(label) OVER (PARTITION BY subject ORDER BY i) AS t
             FROM tok) x WHERE t IS NOT NULL GROUP BY ALL""",
    ),
)
def transitions_subject(spark, sf_dir):
    return S.transitions(event_sequence(spark, sf_dir), "subject")


@query(
    "transitions_conversation",
    """WITH tok AS (
         SELECT conv_id, turn, role FROM conversations
         UNION ALL SELECT DISTINCT conv_id, -1, '<start>' FROM conversations
         UNION ALL SELECT conv_id, max(turn) + 1, '<end>' FROM conversations GROUP BY conv_id)
       SELECT 'all' AS subject, f AS "from", t AS "to", count(*) AS n FROM (
         SELECT role AS f, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM tok) x
       WHERE t IS NOT NULL GROUP BY ALL""",
)
def transitions_conversation(spark, sf_dir):
    seq = S.sequence(
        table(spark, sf_dir, "conversations"),
        subject=F.lit("all"),
        song=F.col("conv_id"),
        order=[F.col("turn")],
        label=F.col("role"),
        chunk=S.chunk_of_position(F.col("turn"), 1000),
    )
    return S.transitions(seq)


DENSE_SQL = """
ax AS (SELECT DISTINCT subject, label, 1 AS k FROM voc
       UNION ALL SELECT DISTINCT subject, '<start>', 0 FROM voc
       UNION ALL SELECT DISTINCT subject, '<end>', 2 FROM voc),
num AS (SELECT subject, label, row_number() OVER (PARTITION BY subject ORDER BY k, label) - 1 AS i
        FROM ax),
m1 AS (SELECT a.subject, a.label AS f, b.label AS t, a.i AS i, b.i AS j, coalesce(p.n, 0) AS n,
              coalesce(p.p, 0) AS p1
       FROM num a JOIN num b ON a.subject = b.subject
       LEFT JOIN prob p ON p.subject = a.subject AND p.f = a.label AND p.t = b.label),
m2 AS (SELECT a.subject, a.f, b.t, sum(a.p1 * b.p1) AS p2 FROM m1 a
       JOIN m1 b ON a.subject = b.subject AND a.t = b.f GROUP BY ALL),
m3 AS (SELECT a.subject, a.f, b.t, sum(a.p2 * b.p1) AS p3 FROM m2 a
       JOIN m1 b ON a.subject = b.subject AND a.t = b.f GROUP BY ALL)
"""


@query(
    "transition_matrix",
    sql(B.TOKEN_SQL, DENSE_SQL, f"""SELECT m1.subject, m1.f AS "from", m1.t AS "to",
        m1.i::BIGINT AS "row", m1.j::BIGINT AS "col", m1.n::BIGINT AS n, {r6('p1', digits=10)}, {r6('p2', digits=10)},
        {r6('p3', digits=10)}
        FROM m1 JOIN m2 ON m2.subject = m1.subject AND m2.f = m1.f AND m2.t = m1.t
        JOIN m3 ON m3.subject = m1.subject AND m3.f = m1.f AND m3.t = m1.t"""),
)
def transition_matrix(spark, sf_dir):
    out = S.transition_matrix(S.transitions(event_sequence(spark, sf_dir)))
    out = out.withColumns({c: F.col(c).cast("long") for c in ("row", "col")})
    return round_all(out, ["p1", "p2", "p3"], 10).drop("axis")


@query(
    "transition_power",
    sql(B.TOKEN_SQL, DENSE_SQL, f"""SELECT subject, f AS "from", t AS "to", {r6('p3', 'p', 10)}
        FROM m3 WHERE p3 > 0"""),
)
def transition_power(spark, sf_dir):
    probs = S.transition_probabilities(S.transitions(event_sequence(spark, sf_dir)))
    return round_all(S.transition_power(probs, 3), ["p"], 10)


@query(
    "transition_probabilities_out",
    sql(B.TOKEN_SQL, f"""SELECT subject, f AS "from", t AS "to", n::BIGINT AS n,
        {r6('n / sum(n) OVER (PARTITION BY subject, f)', 'p')} FROM tr"""),
)
def transition_probabilities_out(spark, sf_dir):
    counts = S.transitions(event_sequence(spark, sf_dir))
    return round_all(S.transition_probabilities(counts, "out"), ["p"])


@query(
    "order_labels",
    sql(B.EVENT_SQL, f"""SELECT subject, label, {r6('avg(pos)', 'mean_pos')},
        row_number() OVER (PARTITION BY subject ORDER BY avg(pos), label) AS label_rank
        FROM seq GROUP BY subject, label"""),
)
def order_labels(spark, sf_dir):
    seq = event_sequence(spark, sf_dir)
    vocab = S.vocabulary(S.label_counts(seq))
    return round_all(S.order_labels(S.with_positions(seq), vocab), ["mean_pos"])


@query("entropy", sql(B.TOKEN_SQL, B.ENTROPY_SQL, f"SELECT subject, {r6('entropy')} FROM ent"))
def entropy(spark, sf_dir):
    probs = S.transition_probabilities(S.transitions(event_sequence(spark, sf_dir)))
    return round_all(S.entropy(probs), ["entropy"])


@query(
    "entropy_scaled",
    sql(B.TOKEN_SQL, B.ENTROPY_SQL, f"SELECT subject, {r6('entropy_scaled')} FROM ent"),
)
def entropy_scaled(spark, sf_dir):
    runs = S.run_lengths(event_sequence(spark, sf_dir))
    probs = S.transition_probabilities(S.transitions(runs))
    vocab = S.vocabulary(S.label_counts(runs))
    return round_all(S.entropy_scaled(probs, vocab), ["entropy_scaled"])


@query("run_lengths", sql(B.TOKEN_SQL, "SELECT subject, song_id, label, length FROM runs"))
def run_lengths(spark, sf_dir):
    runs = S.run_lengths(event_sequence(spark, sf_dir))
    return runs.select("subject", "song_id", "label", "length")


@query("repeat_histogram", sql(B.TOKEN_SQL, "SELECT subject, label, length, n FROM hist"))
def repeat_histogram(spark, sf_dir):
    return S.repeat_histogram(S.run_lengths(event_sequence(spark, sf_dir)))


# below the longest possible length the window recurrence gives the maximal runs again
@query("repeat_histogram_windows", sql(B.TOKEN_SQL, "SELECT subject, label, length, n FROM hist"))
def repeat_histogram_windows(spark, sf_dir):
    return S.repeat_histogram(S.run_lengths(event_sequence(spark, sf_dir)), cap="reference")


@query(
    "significant_repeats",
    sql(B.TOKEN_SQL, B.SIGNIFICANT_SQL,
        f"SELECT subject, label, length, n, {r6('repeat_share')} FROM shist"),
)
def significant_repeats(spark, sf_dir):
    runs = S.run_lengths(event_sequence(spark, sf_dir))
    vocab = S.vocabulary(S.label_counts(runs))
    hist = S.significant_repeats(S.repeat_histogram(runs), vocab, B.SIGNIFICANCE)
    return round_all(hist, ["repeat_share"])


REPEAT_DOUBLES = ["mean_repeat", "median_repeat", "var_repeat", "skew_repeat", "kurt_repeat"]


@query(
    "repeat_stats",
    sql(B.TOKEN_SQL, B.SIGNIFICANT_SQL, B.REPEAT_STATS_SQL,
        f"""SELECT subject, repeat_bool, dyad_bool, num_dyad, num_longer,
            {', '.join(r6(c) for c in REPEAT_DOUBLES)} FROM rep"""),
)
def repeat_stats(spark, sf_dir):
    runs = S.run_lengths(event_sequence(spark, sf_dir))
    vocab = S.vocabulary(S.label_counts(runs))
    hist = S.significant_repeats(S.repeat_histogram(runs), vocab, B.SIGNIFICANCE)
    return round_all(S.repeat_stats(hist, B.DYADS), REPEAT_DOUBLES)


@query(
    "intro_labels",
    sql(B.TOKEN_SQL, B.INTRO_SQL, f"SELECT subject, label, n_led, {r6('share_led')} FROM intro"),
)
def intro_labels(spark, sf_dir):
    return round_all(S.intro_labels(event_sequence(spark, sf_dir)), ["share_led"])


@query(
    "intro_stats",
    sql(B.TOKEN_SQL, B.INTRO_SQL, f"""SELECT subject, array_to_string(intro_labels, ',')
        AS intro_labels, intro_recurs, {r6('mean_intro')}, {r6('std_intro')}, isong.leading AS "leading",
        count(*) AS n FROM ilab JOIN istat USING (subject) JOIN isong USING (subject)
        GROUP BY subject, ilab.intro_labels, intro_recurs, mean_intro, std_intro, isong.leading"""),
)
def intro_stats(spark, sf_dir):
    runs = S.run_lengths(event_sequence(spark, sf_dir))
    stats = S.intro_stats(runs, S.intro_labels(runs), S.label_counts(runs))
    out = stats.select(
        "subject",
        F.array_join("intro_labels", ",").alias("intro_labels"),
        "intro_recurs",
        "mean_intro",
        "std_intro",
        F.explode("intro_runs").alias("leading", "n"),
    )
    return round_all(out, ["mean_intro", "std_intro"])


@query(
    "without_intro",
    sql(B.TOKEN_SQL, B.INTRO_SQL, """SELECT subject, song_id, label, pos FROM seq
        WHERE NOT EXISTS (SELECT 1 FROM intro i WHERE i.subject = seq.subject
                          AND i.label = seq.label)"""),
)
def without_intro(spark, sf_dir):
    seq = event_sequence(spark, sf_dir)
    rest = S.without_intro(S.with_positions(seq), S.intro_labels(seq))
    return rest.select("subject", "song_id", "label", "pos")


@query(
    "without_intro_entropy",
    sql(B.TOKEN_SQL, B.ENTROPY_SQL, B.INTRO_SQL, B.REST_SQL,
        f"SELECT subject, {r6('entropy_no_intro')}, {r6('entropy_scaled_no_intro')} FROM rest"),
)
def without_intro_entropy(spark, sf_dir):
    rows = P.phenotype(event_sequence(spark, sf_dir), PARAMS)
    names = ["entropy_no_intro", "entropy_scaled_no_intro"]
    return round_all(rows.select("subject", *names), names)


PHENOTYPE_DOUBLES = [
    "entropy", "entropy_scaled", "entropy_no_intro", "entropy_scaled_no_intro",
    *REPEAT_DOUBLES, "mean_intro", "std_intro",
]
PHENOTYPE_OTHERS = [
    "n_songs", "n_segments", "repertoire_size", "repeat_bool", "dyad_bool", "num_dyad",
    "num_longer", "has_intro", "intro_recurs",
]
PHENOTYPE_SQL = """
base AS (SELECT subject, count(DISTINCT song_id) AS n_songs, count(*) AS n_segments
         FROM seq GROUP BY subject),
size AS (SELECT subject, count(*) FILTER (proportion > 0.02) AS repertoire_size
         FROM voc GROUP BY subject),
pheno AS (
  SELECT base.subject, n_songs, n_segments, repertoire_size, entropy, entropy_scaled,
    entropy_no_intro, entropy_scaled_no_intro, coalesce(repeat_bool, false) AS repeat_bool,
    coalesce(dyad_bool, false) AS dyad_bool, coalesce(num_dyad, 0) AS num_dyad,
    coalesce(num_longer, 0) AS num_longer,
    CASE WHEN repeat_bool IS NULL THEN 0 ELSE mean_repeat END AS mean_repeat,
    CASE WHEN repeat_bool IS NULL THEN 0 ELSE median_repeat END AS median_repeat,
    CASE WHEN repeat_bool IS NULL THEN 0 ELSE var_repeat END AS var_repeat,
    CASE WHEN repeat_bool IS NULL THEN 0 ELSE skew_repeat END AS skew_repeat,
    CASE WHEN repeat_bool IS NULL THEN 0 ELSE kurt_repeat END AS kurt_repeat,
    ilab.subject IS NOT NULL AS has_intro, coalesce(intro_recurs, false) AS intro_recurs,
    coalesce(mean_intro, 0) AS mean_intro, coalesce(std_intro, 0) AS std_intro,
    coalesce(array_to_string(intro_labels, ','), '') AS intro_labels
  FROM base JOIN size USING (subject) JOIN ent USING (subject) JOIN rest USING (subject)
  LEFT JOIN rep USING (subject) LEFT JOIN ilab USING (subject) LEFT JOIN istat USING (subject))
"""
ALL_PHENOTYPE_SQL = (
    B.TOKEN_SQL, B.ENTROPY_SQL, B.INTRO_SQL, B.REST_SQL, B.SIGNIFICANT_SQL, B.REPEAT_STATS_SQL,
    PHENOTYPE_SQL,
)
PHENOTYPE_SELECT = f"""subject, {', '.join(PHENOTYPE_OTHERS)}, intro_labels,
    {', '.join(r6(c) for c in PHENOTYPE_DOUBLES)}"""


def flat(rows):
    text = F.coalesce(F.array_join("intro_labels", ","), F.lit(""))
    return round_all(rows.withColumn("intro_labels", text), PHENOTYPE_DOUBLES)


@query("phenotype", sql(*ALL_PHENOTYPE_SQL, f"SELECT {PHENOTYPE_SELECT} FROM pheno"))
def phenotype(spark, sf_dir):
    rows = flat(P.phenotype(event_sequence(spark, sf_dir), PARAMS))
    return rows.select("subject", *PHENOTYPE_OTHERS, "intro_labels", *PHENOTYPE_DOUBLES)


AUTO_SQL = """
aseq AS (SELECT user_id AS subject, strftime(date_trunc('week', ts), '%Y-%m-%d') AS song_id,
           row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id)
             - 1 AS pos,
           CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS label
         FROM events),
atok AS (SELECT * FROM aseq
   UNION ALL SELECT subject, song_id, -1, '<start>' FROM aseq GROUP BY ALL
   UNION ALL SELECT subject, song_id, max(pos) + 1, '<end>' FROM aseq GROUP BY subject, song_id),
atr AS (SELECT subject, f, t, count(*) AS n FROM (
    SELECT subject, label AS f, lead(label) OVER (PARTITION BY subject, song_id ORDER BY pos) AS t
    FROM atok) x WHERE t IS NOT NULL GROUP BY ALL),
aent AS (SELECT a.subject, sum(CASE WHEN f NOT LIKE '<%' AND t NOT LIKE '<%'
           THEN -(a.n / d.n) * ln(a.n / d.n) ELSE 0 END) AS entropy
   FROM atr a LEFT JOIN (SELECT subject, t AS l, sum(n) AS n FROM atr GROUP BY ALL) d
     ON d.subject = a.subject AND d.l = a.f GROUP BY a.subject),
arep AS (SELECT subject, count(*) FILTER (s > 0.02) AS repertoire_size FROM (
    SELECT subject, label, count(*) / sum(count(*)) OVER (PARTITION BY subject) AS s
    FROM aseq GROUP BY subject, label) x GROUP BY subject),
anoise AS (SELECT subject, count(*) AS n_segments FROM aseq GROUP BY subject)
"""


def manual_and_auto(spark, sf_dir):
    seq = event_sequence(spark, sf_dir, ("value",))
    auto = seq.withColumn(
        "label", F.expr("CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' "
                        "ELSE 'high' END")
    ).drop("value")
    rows = P.phenotype(auto, PARAMS).withColumn("rank", F.lit(0))
    return P.phenotype(seq.drop("value"), PARAMS), rows


@query(
    "phenotype_table",
    sql(B.TOKEN_SQL, B.ENTROPY_SQL, AUTO_SQL, f"""
        SELECT subject, 'manual' AS rank, n_segments, repertoire_size, {r6('entropy')},
               NULL::BIGINT AS n_clusters
        FROM ent JOIN (SELECT subject, count(*) FILTER (proportion > 0.02) AS repertoire_size,
                       sum(n)::BIGINT AS n_segments FROM voc GROUP BY subject) USING (subject)
        UNION ALL
        SELECT subject, '0', n_segments, repertoire_size, {r6('entropy')}, 3
        FROM aent JOIN arep USING (subject) JOIN anoise USING (subject)"""),
)
def phenotype_table(spark, sf_dir):
    manual, autos = manual_and_auto(spark, sf_dir)
    ranks = autos.select(
        "subject", "rank", F.lit("bands").alias("method"), F.lit(None).cast("double")
        .alias("composite"), F.lit(3).cast("long").alias("n_clusters"),
    )
    rows = P.phenotype_table(manual, autos, ranks)
    out = rows.select("subject", "rank", "n_segments", "repertoire_size", "entropy", "n_clusters")
    return round_all(out, ["entropy"])


@query(
    "repeat_position",
    sql(B.EVENT_SQL, """SELECT event_id, CASE WHEN label <> 'error' THEN row_number() OVER (
          PARTITION BY subject, song_id, label, g ORDER BY pos) END AS repeat_pos FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY subject, song_id, label ORDER BY pos) AS g
        FROM seq) x"""),
)
def repeat_position(spark, sf_dir):
    seq = event_sequence(spark, sf_dir, ("event_id",))
    return S.repeat_position(seq, noise=["error"]).select("event_id", "repeat_pos")


@query(
    "identity_tags",
    sql(B.TOKEN_SQL, B.INTRO_SQL, f"""SELECT v.subject, v.label, v.n, {r6('v.proportion')},
        concat_ws(',', CASE WHEN i.label IS NOT NULL THEN 'intro' END,
          CASE WHEN d.dy > {B.DYADS} THEN 'dyad' WHEN d.dy IS NOT NULL THEN 'repeats' END) AS tags
        FROM voc v LEFT JOIN intro i ON i.subject = v.subject AND i.label = v.label
        LEFT JOIN (SELECT subject, label, sum(CASE WHEN length = 2 THEN n ELSE 0 END) / sum(n) AS dy
                   FROM hist GROUP BY ALL) d ON d.subject = v.subject AND d.label = v.label"""),
)
def identity_tags(spark, sf_dir):
    runs = S.run_lengths(event_sequence(spark, sf_dir))
    vocab = S.vocabulary(S.label_counts(runs))
    tags = S.identity_tags(vocab, S.intro_labels(runs), S.repeat_histogram(runs), B.DYADS)
    return round_all(tags, ["proportion"])


@query(
    "outgoing",
    sql(B.TOKEN_SQL, f"""SELECT subject, f AS "from", t AS "to", {r6('p')} FROM prob
        WHERE p > 0.01 AND f <> '<start>'"""),
)
def outgoing(spark, sf_dir):
    probs = S.transition_probabilities(S.transitions(event_sequence(spark, sf_dir)))
    return round_all(S.outgoing(probs), ["p"]).drop("n")


@query(
    "compare_vocabulary",
    sql(B.TOKEN_SQL, B.ENTROPY_SQL, AUTO_SQL, f"""SELECT ent.subject,
          (SELECT count(*) FROM voc v WHERE v.subject = ent.subject AND proportion > 0.02)
            AS manual_repertoire, {r6('ent.entropy', 'manual_entropy')},
          arep.repertoire_size AS "0_repertoire", {r6('aent.entropy', '"0_entropy"')}
        FROM ent JOIN aent USING (subject) JOIN arep USING (subject)"""),
)
def compare_vocabulary(spark, sf_dir):
    manual, autos = manual_and_auto(spark, sf_dir)
    out = P.compare_vocabulary(P.phenotype_table(manual, autos), 1)
    return round_all(out, ["manual_entropy", "0_entropy"])


