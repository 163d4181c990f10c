"""How the given tables play the roles of sequences, vectors, features, scores and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators.sequences import sequence
from strophe.plans.registry import table


def event_sequence(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Events of one user in one week are a song; hours of the week are its chunks."""
    events = table(spark, sf_dir, "events")
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return sequence(
        events,
        subject=F.col("user_id"),
        song=week,
        order=[F.col("ts"), F.col("event_id")],
        label=F.col("event_type"),
        chunk=F.weekday("ts") * 24 + F.hour("ts"),
        extra=extra,
    )


EVENT_SQL = """
seq AS (
  SELECT user_id AS subject, strftime(date_trunc('week', ts), '%Y-%m-%d') AS song_id,
         row_number() OVER (PARTITION BY user_id, date_trunc('week', ts)
                            ORDER BY ts, event_id) - 1 AS pos,
         event_type AS label, event_id, value
  FROM events)
"""

TOKEN_SQL = (
    EVENT_SQL
    + """,
tok AS (
  SELECT subject, song_id, pos, label FROM seq
  UNION ALL SELECT subject, song_id, -1, '<start>' FROM seq GROUP BY ALL
  UNION ALL SELECT subject, song_id, max(pos) + 1, '<end>' FROM seq GROUP BY subject, song_id),
tr AS (
  SELECT subject, f, t, count(*) AS n FROM (
    SELECT subject, label AS f,
           lead(label) OVER (PARTITION BY subject, song_id ORDER BY pos) AS t FROM tok) x
  WHERE t IS NOT NULL GROUP BY ALL),
prob AS (
  SELECT tr.subject, f, t, tr.n, coalesce(tr.n / d.n, 0) AS p
  FROM tr LEFT JOIN (SELECT subject, t AS l, sum(n) AS n FROM tr GROUP BY ALL) d
    ON d.subject = tr.subject AND d.l = tr.f),
voc AS (
  SELECT subject, label, count(*) AS n,
         count(*) / sum(count(*)) OVER (PARTITION BY subject) AS proportion
  FROM seq GROUP BY subject, label),
runs AS (
  SELECT subject, song_id, label, min(pos) AS pos, count(*) AS length FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY subject, song_id, label ORDER BY pos) AS g
    FROM seq) x GROUP BY subject, song_id, label, g),
hist AS (
  SELECT subject, label, length, count(*) AS n FROM runs WHERE length >= 2 GROUP BY ALL)
"""
)

# repeats count from a quarter of a label's rows on: the events table repeats by chance only
SIGNIFICANCE = 0.25
DYADS = 0.8

SIGNIFICANT_SQL = f"""
sig AS (
  SELECT h.subject, h.label, v.n AS label_n, sum(h.length * h.n) / v.n AS repeat_share
  FROM hist h JOIN (SELECT *, count(*) OVER (PARTITION BY subject) AS k FROM voc) v
    ON v.subject = h.subject AND v.label = h.label
  WHERE v.proportion >= 0.25 / v.k
  GROUP BY h.subject, h.label, v.n
  HAVING sum(h.length * h.n) / v.n >= {SIGNIFICANCE}),
shist AS (
  SELECT h.*, s.repeat_share FROM hist h JOIN sig s
    ON s.subject = h.subject AND s.label = h.label)
"""

REPEAT_STATS_SQL = f"""
dy AS (
  SELECT *, coalesce(sum(n) FILTER (length = 2) OVER (PARTITION BY subject, label), 0)
            / sum(n) OVER (PARTITION BY subject, label) > {DYADS} AS dyad FROM shist),
per AS (
  SELECT subject, count(DISTINCT label) AS k,
         count(DISTINCT label) FILTER (dyad) AS num_dyad FROM dy GROUP BY subject),
exp AS (
  SELECT subject, CAST(length AS DOUBLE) AS x
  FROM dy, unnest(range(n)) u(i) WHERE NOT (dyad AND length = 2)),
mom AS (
  SELECT subject, avg(x) AS m, median(x) AS md, var_pop(x) AS v FROM exp GROUP BY subject),
mom2 AS (
  SELECT e.subject, any_value(m) AS m, any_value(md) AS md, any_value(v) AS v,
         avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4
  FROM exp e JOIN mom USING (subject) GROUP BY e.subject),
rep AS (
  SELECT per.subject, true AS repeat_bool, num_dyad > 0 AS dyad_bool, num_dyad,
         k - num_dyad AS num_longer, coalesce(m, 0) AS mean_repeat,
         coalesce(md, 0) AS median_repeat, coalesce(v, 0) AS var_repeat,
         CASE WHEN m IS NULL THEN 0 WHEN v > 0 THEN m3 / v ** 1.5 END AS skew_repeat,
         CASE WHEN m IS NULL THEN 0 WHEN v > 0 THEN m4 / (v * v) - 3 END AS kurt_repeat
  FROM per LEFT JOIN mom2 USING (subject))
"""

INTRO_SQL = """
firsts AS (SELECT subject, song_id, label FROM seq WHERE pos = 0),
intro AS (
  SELECT subject, label, count(*) AS n_led, count(*) / any_value(k) AS share_led
  FROM firsts JOIN (SELECT subject, count(*) AS k FROM firsts GROUP BY ALL) USING (subject)
  GROUP BY subject, label HAVING count(*) / any_value(k) >= 0.5),
isong AS (
  SELECT s.subject, s.song_id, count(i.label) AS n_intro,
         coalesce(min(CASE WHEN i.label IS NULL THEN pos END), count(*)) AS "leading"
  FROM seq s LEFT JOIN intro i ON i.subject = s.subject AND i.label = s.label
  WHERE s.subject IN (SELECT subject FROM intro)
  GROUP BY s.subject, s.song_id),
istat AS (
  SELECT subject, avg(n_intro) AS mean_intro, stddev_pop(n_intro) AS std_intro
  FROM isong GROUP BY subject),
ilab AS (
  SELECT i.subject, list(i.label ORDER BY i.label) AS intro_labels, bool_or(v.n > i.n_led)
         AS intro_recurs
  FROM intro i JOIN voc v ON v.subject = i.subject AND v.label = i.label GROUP BY i.subject)
"""

ENTROPY_SQL = """
ent AS (
  SELECT p.subject,
    sum(CASE WHEN f NOT LIKE '<%' AND t NOT LIKE '<%' AND p > 0 THEN -p * ln(p) ELSE 0 END)
      AS entropy,
    sum(CASE WHEN f NOT LIKE '<%' AND t NOT LIKE '<%' AND p > 0
        THEN -p * ln(p) * v.proportion ELSE 0 END) AS entropy_scaled
  FROM prob p LEFT JOIN voc v ON v.subject = p.subject AND v.label = p.f GROUP BY p.subject)
"""

REST_SQL = """
rseq AS (
  SELECT subject, song_id, label,
         row_number() OVER (PARTITION BY subject, song_id ORDER BY pos) - 1 AS pos
  FROM seq WHERE subject IN (SELECT subject FROM intro)
    AND NOT EXISTS (SELECT 1 FROM intro i WHERE i.subject = seq.subject AND i.label = seq.label)),
rtok AS (
  SELECT subject, song_id, pos, label FROM rseq
  UNION ALL SELECT subject, song_id, -1, '<start>' FROM rseq GROUP BY ALL
  UNION ALL SELECT subject, song_id, max(pos) + 1, '<end>' FROM rseq GROUP BY subject, song_id),
rtr AS (
  SELECT subject, f, t, count(*) AS n FROM (
    SELECT subject, label AS f,
           lead(label) OVER (PARTITION BY subject, song_id ORDER BY pos) AS t FROM rtok) x
  WHERE t IS NOT NULL GROUP BY ALL),
rprob AS (
  SELECT rtr.subject, f, t, rtr.n / d.n AS p
  FROM rtr JOIN (SELECT subject, t AS l, sum(n) AS n FROM rtr GROUP BY ALL) d
    ON d.subject = rtr.subject AND d.l = rtr.f),
rvoc AS (
  SELECT subject, label,
         count(*) / sum(count(*)) OVER (PARTITION BY subject) AS proportion
  FROM rseq GROUP BY subject, label),
rent AS (
  SELECT p.subject, sum(CASE WHEN t NOT LIKE '<%' THEN -p * ln(p) ELSE 0 END) AS e,
         sum(CASE WHEN t NOT LIKE '<%' THEN -p * ln(p) * v.proportion ELSE 0 END) AS es
  FROM rprob p JOIN rvoc v ON v.subject = p.subject AND v.label = p.f GROUP BY p.subject),
rest AS (
  SELECT ent.subject,
    CASE WHEN i.subject IS NULL THEN entropy ELSE coalesce(e, 0) END AS entropy_no_intro,
    CASE WHEN i.subject IS NULL THEN entropy_scaled ELSE coalesce(es, 0) END
      AS entropy_scaled_no_intro
  FROM ent LEFT JOIN (SELECT DISTINCT subject FROM intro) i USING (subject)
  LEFT JOIN rent USING (subject))
"""


def sql(*parts: str, recursive: bool = False) -> str:
    """Join named sub-queries and a final SELECT into one statement."""
    *ctes, last = parts
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(c.strip() for c in ctes)} {last}"


def r6(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr.split('.')[-1]}"
