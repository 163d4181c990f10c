"""Feature statistics: order lines are segments, flag and status their hand-made label."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.scalars import round_all
from strophe.operators import features as X
from strophe.operators import sequences as S
from strophe.plans.bindings import EVENT_SQL, event_sequence, r6, sql
from strophe.plans.registry import query, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYWORDS = ["price", "tax"]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.when(F.col("l_linenumber") == 7, -1)
        .otherwise(F.col("l_linenumber") % 3)
        .alias("cluster"),
        (F.col("l_suppkey") % 4).cast("int").alias("cluster2"),
        F.col("l_linenumber").alias("subject"),
        *FEATURES[:3],
        F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax"),
    )


LINES_SQL = """
li AS (SELECT l_returnflag || l_linestatus AS label,
         CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber % 3 END AS cluster,
         (l_suppkey % 4)::INT AS cluster2, l_linenumber AS subject, l_quantity, l_extendedprice,
         l_discount, CASE WHEN l_tax > 0.01 THEN l_tax END AS l_tax FROM lineitem),
lng AS (SELECT label, cluster, cluster2, subject, feature, value FROM li
        UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))
"""


def moments_sql(name: str, label: str, by: str = "", where: str = "true") -> str:
    keys = f"{by + ', ' if by else ''}feature"
    return f"""{name} AS (SELECT {keys}, {label} AS label, count(*) AS n, avg(value) AS mean,
        var_pop(value) * count(*) AS ss, var_samp(value) AS vs FROM lng WHERE {where}
        GROUP BY {keys}, {label})"""


def anova_sql(name: str, moments: str, by: str = "") -> str:
    keys = f"{by + ', ' if by else ''}feature"
    return f"""{name} AS (SELECT {keys}, k AS n_labels, n, ssb * (n - k) / (ssw * (k - 1))
          AS f_statistic, ssb / (ssb + ssw) AS eta_squared FROM (
        SELECT {keys}, count(*) AS k, sum(n)::BIGINT AS n, sum(ss) AS ssw,
          sum(n * (mean - grand) ** 2) AS ssb FROM (
          SELECT *, sum(n * mean) OVER (PARTITION BY {keys}) / sum(n) OVER (PARTITION BY {keys})
            AS grand FROM {moments}) g GROUP BY {keys}) h)"""


def separation_sql(name: str, moments: str) -> str:
    return f"""{name} AS (SELECT feature, w AS within, b AS between_, n,
          CASE WHEN w > 0 THEN b / w END AS ratio FROM (
        SELECT feature, sum(n)::BIGINT AS n,
          sum(CASE WHEN n > 1 THEN vs * n ELSE 0 END) / sum(n) AS w,
          sum(CASE WHEN n > 1 THEN n * (mean - grand) ** 2 ELSE 0 END) / sum(n) AS b FROM (
          SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature)
            AS grand FROM {moments}) g GROUP BY feature) h)"""


ANOVA = (LINES_SQL, moments_sql("mo", "label"), anova_sql("an", "mo"))
KNOWN = "cluster <> -1"


@query(
    "build_feature_db",
    """SELECT e.event_id AS segment_id, e.event_type AS label, o.o_totalprice AS price,
         coalesce(v.label, -1) AS cluster_emb, coalesce(l.quality, -1) AS cluster_quality
       FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id
       LEFT JOIN embeddings v ON v.vec_id = e.event_id
       LEFT JOIN labels l ON l.doc_id = e.event_id""",
)
def build_feature_db(spark, sf_dir):
    segs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("segment_id"), F.col("event_type").alias("label")
    )
    features = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("segment_id"), F.col("o_totalprice").alias("price")
    )
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("segment_id"), F.lit("emb").alias("method"), "label"
    ).unionByName(
        table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("segment_id"), F.lit("quality").alias("method"),
            F.col("quality").alias("label"),
        )
    )
    return X.build_feature_db(segs, features, labels, ["emb", "quality"])


@query(
    "expand_label_map",
    """SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS cluster_k,
              CAST(props ->> '$.absent' AS INTEGER) AS cluster_absent FROM events""",
)
def expand_label_map(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return X.expand_label_map(events, "props", ["k", "absent"]).drop("props")


@query(
    "numeric_features",
    sql(LINES_SQL, f"""SELECT feature, {r6('avg(value)', 'mean')} FROM lng GROUP BY feature"""),
)
def numeric_features(spark, sf_dir):
    df = lines(spark, sf_dir).drop("cluster", "cluster2")
    names = X.numeric_features(df, exclude=["subject"])
    means = df.agg(*[F.avg(n).alias(n) for n in names])
    return round_all(X.unpivot(means, [], names, value="mean"), ["mean"])


@query(
    "feature_coverage",
    sql(LINES_SQL, f"""SELECT f.feature, (SELECT count(*) FROM li) AS n, count(*) AS present,
        {r6('count(*) / (SELECT count(*) FROM li)', 'coverage')} FROM lng f GROUP BY f.feature"""),
)
def feature_coverage(spark, sf_dir):
    return round_all(X.feature_coverage(lines(spark, sf_dir), FEATURES), ["coverage"])


SUMMARY = ["duration_mean", "duration_std", "duration_min", "duration_max", "duration_median",
           "label_coverage"]


@query(
    "db_summary",
    f"""SELECT user_id AS subject, count(*) AS n_segments,
          count(CASE WHEN event_type <> 'error' THEN 1 END) AS n_labelled,
          count(DISTINCT date_trunc('week', ts)) AS n_songs,
          count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) AS n_labels,
          {r6('avg(value)', 'duration_mean')}, {r6('stddev_samp(value)', 'duration_std')},
          {r6('min(value)', 'duration_min')}, {r6('max(value)', 'duration_max')},
          {r6('median(value)', 'duration_median')},
          {r6("count(CASE WHEN event_type <> 'error' THEN 1 END) / count(*)", 'label_coverage')}
        FROM events GROUP BY user_id""",
)
def db_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"),
        F.date_trunc("week", "ts").alias("song_id"),
        F.col("value").alias("duration"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"),
    )
    return round_all(X.db_summary(events), SUMMARY)


@query(
    "summary_by_label",
    sql(LINES_SQL, f"""SELECT label, count(*) AS count, {r6('avg(l_extendedprice)', 'mean', 3)},
        {r6('stddev_samp(l_extendedprice)', 'std', 3)}, {r6('min(l_extendedprice)', 'min', 3)},
        {r6('max(l_extendedprice)', 'max', 3)}, {r6('median(l_extendedprice)', 'median', 3)}
        FROM li GROUP BY label"""),
)
def summary_by_label(spark, sf_dir):
    return X.summary_by_label(lines(spark, sf_dir), "l_extendedprice")


TIMING = ["l_quantity", "l_discount", "l_tax"]


@query(
    "label_timing_stats",
    sql(LINES_SQL, " UNION ALL ".join(
        f"SELECT '{c}' AS label_set, {c}::VARCHAR AS label, count(*) AS n, "
        + ", ".join(r6(f"avg({m})", f"mean_{m}") for m in TIMING) + f" FROM li GROUP BY {c}"
        for c in ("label", "cluster"))),
)
def label_timing_stats(spark, sf_dir):
    out = X.label_timing_stats(lines(spark, sf_dir), ["label", "cluster"], TIMING)
    return round_all(out, [f"mean_{m}" for m in TIMING])


@query(
    "separation",
    sql(LINES_SQL, moments_sql("mo", "cluster", where=KNOWN), separation_sql("se", "mo"),
        f"SELECT feature, n, {r6('within')}, {r6('between_', 'between')}, "
        f"{r6('ratio', digits=9)} FROM se"),
)
def separation(spark, sf_dir):
    known = lines(spark, sf_dir).where("cluster <> -1")
    out = X.separation(X.label_moments(known, FEATURES, "cluster"))
    return round_all(round_all(out, ["within", "between"]), ["ratio"], 9)


SEP_NAMES = ["mean_ratio", "median_ratio", "min_ratio", "max_ratio"]


@query(
    "separation_summary",
    sql(LINES_SQL, moments_sql("mo", "cluster", where=KNOWN), separation_sql("se", "mo"),
        "SELECT count(ratio) AS n_features, " + ", ".join(
            r6(f"{f}(ratio)", f"{n}_ratio", 9) for f, n in
            [("avg", "mean"), ("median", "median"), ("min", "min"), ("max", "max")]) + " FROM se"),
)
def separation_summary(spark, sf_dir):
    known = lines(spark, sf_dir).where("cluster <> -1")
    out = X.separation_summary(X.separation(X.label_moments(known, FEATURES, "cluster")))
    return round_all(out, SEP_NAMES, 9)


COMPARE = (
    LINES_SQL, moments_sql("ma", "label", where=KNOWN), separation_sql("sa", "ma"),
    moments_sql("mb", "cluster", where=KNOWN), separation_sql("sb", "mb"),
)


@query(
    "compare_separation",
    sql(*COMPARE, f"""SELECT feature, {r6('sa.ratio', 'manual_ratio', 9)},
        {r6('sb.ratio', 'cluster_ratio', 9)}, {r6('sb.ratio / sa.ratio', 'relative_quality')}
        FROM sa JOIN sb USING (feature)"""),
)
def compare_separation(spark, sf_dir):
    out = X.compare_separation(lines(spark, sf_dir), FEATURES, "label", "cluster")
    return round_all(round_all(out, ["relative_quality"]), ["manual_ratio", "cluster_ratio"], 9)


@query(
    "top_methods_report",
    sql(*COMPARE, moments_sql("mc", "label"), separation_sql("sc", "mc"),
        moments_sql("md", "cluster2"), separation_sql("sd", "md"),
        " UNION ALL ".join(
            f"SELECT {i}::INT AS rank, '{c}' AS method, count({s}.ratio) AS n_features, "
            + ", ".join(r6(f"{f}({s}.ratio)", f"{n}_ratio", 9) for f, n in
                        [("avg", "mean"), ("median", "median"), ("min", "min"), ("max", "max")])
            + f", {r6(f'avg({s}.ratio / {m}.ratio)', 'relative_quality')}"
            + f" FROM {s} JOIN {m} USING (feature)"
            for i, c, s, m in [(0, "cluster", "sb", "sa"), (1, "cluster2", "sd", "sc")])),
)
def top_methods_report(spark, sf_dir):
    out = X.top_methods_report(
        lines(spark, sf_dir), FEATURES, "label", ["cluster", "cluster2", "subject"], 2
    )
    return round_all(round_all(out, SEP_NAMES, 9), ["relative_quality"])


@query(
    "anova",
    sql(*ANOVA, f"""SELECT feature, an.n, n_labels, {r6('f_statistic')},
        {r6('eta_squared', digits=9)}, label, {r6('mean')},
        {r6('sqrt(vs)', 'std')} FROM an JOIN mo USING (feature)"""),
)
def anova(spark, sf_dir):
    out = X.anova(lines(spark, sf_dir), FEATURES)
    out = out.where("p_value BETWEEN 0 AND 1").select(
        "feature", "n", "n_labels", "f_statistic", "eta_squared",
        F.explode("mean_by_label").alias("label", "mean"), "std_by_label",
    ).withColumn("std", F.col("std_by_label")[F.col("label")]).drop("std_by_label")
    return round_all(round_all(out, ["f_statistic", "mean", "std"]), ["eta_squared"], 9)


@query("anova_p_values")
def anova_p_values(spark, sf_dir):
    return X.anova(lines(spark, sf_dir), FEATURES).select("feature", "p_value")


ARRAY_SQL = """
lng AS (SELECT vec_id % 5 AS cluster, 'embedding_' || (i - 1) AS feature, embedding[i]::DOUBLE
        AS value FROM embeddings, range(1, 65) r(i))
"""


@query(
    "anova_arrays",
    sql(ARRAY_SQL, moments_sql("mo", "cluster"), anova_sql("an", "mo"),
        f"SELECT feature, n, n_labels, {r6('f_statistic')}, {r6('eta_squared')} FROM an"),
)
def anova_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("cluster", F.col("vec_id") % 5)
    out = X.anova_arrays(rows, "embedding", "cluster").drop(
        "mean_by_label", "std_by_label", "p_value"
    )
    return round_all(out, ["f_statistic", "eta_squared"])


@query(
    "feature_group",
    sql(*ANOVA, f"""SELECT feature, {r6('f_statistic')} FROM an
        WHERE feature LIKE '%price%' OR feature LIKE '%tax%'"""),
)
def feature_group(spark, sf_dir):
    out = X.feature_group(lines(spark, sf_dir), FEATURES, KEYWORDS)
    return round_all(out.where("significant IS NOT NULL").select("feature", "f_statistic"),
                     ["f_statistic"])


# any score in (0, 1) can stand for a p-value: here each user's smallest shares of value
FDR_SQL = """
p AS (SELECT user_id AS subject, event_type AS feature, exp(-sum(value) / 100) AS p_value
      FROM events GROUP BY ALL),
bh AS (SELECT *, p_value * count(*) OVER (PARTITION BY subject) / row_number() OVER (
         PARTITION BY subject ORDER BY p_value, feature) AS raw,
         row_number() OVER (PARTITION BY subject ORDER BY p_value, feature) AS i FROM p),
adj AS (SELECT subject, feature, p_value, least(1, min(raw) OVER (PARTITION BY subject ORDER BY i
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_corrected FROM bh)
"""


def test_values(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("subject"), F.col("event_type").alias("feature")
    ).agg(F.exp(-F.sum("value") / 100).alias("p_value"))


@query(
    "fdr",
    sql(FDR_SQL, f"""SELECT subject, feature, {r6('p_value', digits=9)},
        {r6('p_corrected', digits=9)}, p_corrected <= 0.05 AS significant_corrected FROM adj"""),
)
def fdr(spark, sf_dir):
    out = X.fdr(test_values(spark, sf_dir), by=["subject"])
    return round_all(out, ["p_value", "p_corrected"], 9)


@query(
    "significance_summary",
    sql(FDR_SQL, "e AS (SELECT *, 1 - p_value AS eta FROM adj)", f"""
        SELECT subject, count(*) AS n_features,
          count(*) FILTER (p_corrected <= 0.05) AS n_significant,
          count(*) FILTER (p_corrected < 0.001) AS n_highly_significant,
          count(*) FILTER (eta >= 0.14) AS n_large, count(*) FILTER (eta >= 0.06) AS n_medium,
          {r6('100.0 * count(*) FILTER (p_corrected <= 0.05) / count(*)', 'significant_pct')},
          {r6('avg(eta)', 'mean_effect')}, {r6('median(eta)', 'median_effect')},
          arg_max(feature, eta) AS best_feature FROM e GROUP BY subject"""),
)
def significance_summary(spark, sf_dir):
    rows = X.fdr(test_values(spark, sf_dir), by=["subject"]).withColumn(
        "eta_squared", 1 - F.col("p_value")
    )
    out = X.significance_summary(rows, ["subject"])
    return round_all(out, ["significant_pct", "mean_effect", "median_effect"])


@query(
    "effect_bands",
    sql(FDR_SQL, """SELECT subject, feature, CASE WHEN p_value >= 0.14 THEN 'large'
          WHEN p_value >= 0.06 THEN 'medium' WHEN p_value >= 0.01 THEN 'small'
          ELSE 'negligible' END AS effect FROM p"""),
)
def effect_bands(spark, sf_dir):
    return test_values(spark, sf_dir).select(
        "subject", "feature", X.effect_band(F.col("p_value")).alias("effect")
    )


@query(
    "anova_by_subject",
    sql(LINES_SQL, moments_sql("mo", "label", "subject"), anova_sql("an", "mo", "subject"),
        f"SELECT subject, feature, n, n_labels, {r6('f_statistic')} FROM an"),
)
def anova_by_subject(spark, sf_dir):
    out = X.anova(lines(spark, sf_dir), FEATURES, by=["subject"], p_values=False)
    return round_all(out.select("subject", "feature", "n", "n_labels", "f_statistic"),
                     ["f_statistic"])


@query(
    "means_standardized",
    sql(LINES_SQL, moments_sql("mo", "label"), f"""SELECT label, feature, {r6('mean')},
        {r6('''(mean - avg(mean) OVER (PARTITION BY feature))
             / stddev_samp(mean) OVER (PARTITION BY feature)''', 'z')} FROM mo"""),
)
def means_standardized(spark, sf_dir):
    return round_all(X.means_standardized(lines(spark, sf_dir), FEATURES), ["mean", "z"])


PROFILE_SQL = (
    LINES_SQL, moments_sql("mo", "label"),
    """prof AS (SELECT label, feature, n, mean, sqrt(vs) AS std,
         (mean - avg(mean) OVER w) / stddev_pop(mean) OVER w AS z FROM mo
       WINDOW w AS (PARTITION BY feature))""",
)


@query(
    "cluster_profile",
    sql(*PROFILE_SQL, f"SELECT label, feature, n, {r6('mean')}, {r6('std')}, {r6('z')} FROM prof"),
)
def cluster_profile(spark, sf_dir):
    return round_all(X.cluster_profile(lines(spark, sf_dir), FEATURES), ["mean", "std", "z"])


@query(
    "profile_distance",
    sql(*PROFILE_SQL, f"""SELECT a.label AS label1, b.label AS label2,
        {r6('sqrt(sum((a.mean - b.mean) ** 2))', 'distance')} FROM prof a JOIN prof b
        ON a.feature = b.feature AND a.label < b.label GROUP BY a.label, b.label"""),
)
def profile_distance(spark, sf_dir):
    profile = X.cluster_profile(lines(spark, sf_dir), FEATURES)
    return round_all(X.profile_distance(profile), ["distance"])


@query(
    "variation",
    sql(*PROFILE_SQL, f"""SELECT label, feature, {r6('std / abs(mean)', 'cv')} FROM prof
        WHERE n > 1 AND mean <> 0"""),
)
def variation(spark, sf_dir):
    return round_all(X.variation(lines(spark, sf_dir), FEATURES), ["cv"])


TOP_SQL = """
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label
          ORDER BY abs(z) DESC, feature) AS rank FROM prof) x WHERE rank <= 3)
"""


@query(
    "top_discriminative",
    sql(*PROFILE_SQL, TOP_SQL, f"SELECT label, feature, rank, {r6('z')} FROM top"),
)
def top_discriminative(spark, sf_dir):
    profile = X.cluster_profile(lines(spark, sf_dir), FEATURES)
    return round_all(X.top_discriminative(profile).select("label", "feature", "rank", "z"), ["z"])


QUARTERS = ["q1", "median", "q3"]


@query(
    "discriminative_spread",
    sql(*PROFILE_SQL, TOP_SQL, f"""SELECT t.label, t.feature,
        CASE WHEN l.label = t.label THEN 'this' ELSE 'others' END AS side, count(*) AS n,
        {r6('quantile_cont(value, 0.25)', 'q1')}, {r6('median(value)', 'median')},
        {r6('quantile_cont(value, 0.75)', 'q3')} FROM top t JOIN lng l ON l.feature = t.feature
        GROUP BY t.label, t.feature, side"""),
)
def discriminative_spread(spark, sf_dir):
    df = lines(spark, sf_dir)
    top = X.top_discriminative(X.cluster_profile(df, FEATURES))
    return round_all(X.discriminative_spread(df, top, FEATURES), QUARTERS)


@query(
    "ramping",
    sql(EVENT_SQL, """isl AS (SELECT *, pos - row_number() OVER (PARTITION BY subject, song_id,
            label ORDER BY pos) AS g FROM seq),
          rp AS (SELECT label, value, row_number() OVER (PARTITION BY subject, song_id, label, g
            ORDER BY pos) AS repeat_pos FROM isl),
          m AS (SELECT label, repeat_pos, count(*) AS n, avg(value) AS v FROM rp GROUP BY ALL)""",
        f"""SELECT label, 'value' AS feature, count(*) AS n_positions, sum(n)::BIGINT AS n,
        {r6('regr_slope(v, repeat_pos)', 'slope')}, {r6('regr_intercept(v, repeat_pos)',
        'intercept')}, {r6('corr(v, repeat_pos)', 'r')} FROM m GROUP BY label
        HAVING count(*) >= 3 AND sum(n) > 5"""),
)
def ramping(spark, sf_dir):
    rows = S.repeat_position(event_sequence(spark, sf_dir, ("value",)))
    return round_all(X.ramping(rows, ["value"]), ["slope", "intercept", "r"])


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
PAIR_SQL = "pr AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS r FROM li"
    for a, b in PAIRS) + ")"


@query(
    "correlations",
    sql(LINES_SQL, PAIR_SQL, f"SELECT feature1, feature2, {r6('r')} FROM pr"),
)
def correlations(spark, sf_dir):
    return round_all(X.correlations(lines(spark, sf_dir), FEATURES), ["r"])


@query(
    "redundancy_counts",
    sql(LINES_SQL, PAIR_SQL, """SELECT feature, count(*) AS n FROM (
        SELECT feature1 AS feature FROM pr WHERE abs(r) > 0.001
        UNION ALL SELECT feature2 FROM pr WHERE abs(r) > 0.001) x GROUP BY feature"""),
)
def redundancy_counts(spark, sf_dir):
    pairs = X.correlations(lines(spark, sf_dir), FEATURES)
    return X.redundancy_counts(X.high_correlations(pairs, 0.001))


AGREE_SQL = """
cell AS (SELECT label AS t, cluster AS p, count(*) AS n FROM li GROUP BY ALL),
tot AS (SELECT sum(n)::DOUBLE AS n FROM cell),
rw AS (SELECT t, sum(n)::DOUBLE AS n FROM cell GROUP BY t),
cl AS (SELECT p, sum(n)::DOUBLE AS n FROM cell GROUP BY p),
agr AS (SELECT
  (SELECT sum(c.n / tot.n * ln(c.n * tot.n / (rw.n * cl.n))) FROM cell c, tot, rw, cl
   WHERE rw.t = c.t AND cl.p = c.p)
  / (((SELECT sum(-rw.n / tot.n * ln(rw.n / tot.n)) FROM rw, tot)
    + (SELECT sum(-cl.n / tot.n * ln(cl.n / tot.n)) FROM cl, tot)) / 2) AS nmi,
  (SELECT sum(n * (n - 1) / 2) FROM cell) AS bo, (SELECT sum(n * (n - 1) / 2) FROM rw) AS a,
  (SELECT sum(n * (n - 1) / 2) FROM cl) AS b, (SELECT n * (n - 1) / 2 FROM tot) AS al)
"""


@query(
    "compare_manual_auto",
    sql(*ANOVA, moments_sql("mb", "cluster"), anova_sql("ab", "mb"), AGREE_SQL,
        f"""SELECT feature, {r6('an.f_statistic', 'f_manual')}, {r6('ab.f_statistic', 'f_auto')},
        {r6('ab.f_statistic / an.f_statistic', 'ratio')},
        an.f_statistic > ab.f_statistic AS manual_better, {r6('nmi', digits=9)},
        {r6('(bo - a * b / al) / ((a + b) / 2 - a * b / al)', 'ari', 9)}
        FROM an JOIN ab USING (feature), agr"""),
)
def compare_manual_auto(spark, sf_dir):
    out = X.compare_manual_auto(lines(spark, sf_dir), FEATURES, "label", "cluster")
    return round_all(round_all(out, ["f_manual", "f_auto", "ratio"]), ["nmi", "ari"], 9)


@query(
    "compare_subjects",
    sql(LINES_SQL, moments_sql("mo", "label", "subject"), anova_sql("an", "mo", "subject"),
        f"""SELECT subject, n, n_labels, {r6('f_statistic')}, {r6('eta_squared', digits=9)} FROM an
        WHERE feature = 'l_extendedprice'"""),
)
def compare_subjects(spark, sf_dir):
    out = X.compare_subjects(lines(spark, sf_dir), "l_extendedprice")
    out = out.where("p_value IS NOT NULL").select(
        "subject", "n", "n_labels", "f_statistic", "eta_squared"
    )
    return round_all(round_all(out, ["f_statistic"]), ["eta_squared"], 9)


@query(
    "composition",
    sql(LINES_SQL, "c AS (SELECT cluster, label AS truth, count(*) AS n FROM li GROUP BY ALL)",
        f"""SELECT cluster, truth, n, sum(n) OVER (PARTITION BY cluster)::BIGINT AS cluster_n,
        {r6('n / sum(n) OVER (PARTITION BY cluster)', 'share')},
        {r6('sum(n) OVER (PARTITION BY truth) / sum(n) OVER ()', 'overall_share')},
        first_value(truth) OVER (PARTITION BY cluster ORDER BY n DESC, truth) AS commonest FROM c"""),
)
def composition(spark, sf_dir):
    out = X.composition(lines(spark, sf_dir), "cluster", "label")
    return round_all(out, ["share", "overall_share"])


SAMPLE_SQL = """
s AS (SELECT event_id AS id, user_id AS label,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
        row_number() OVER (PARTITION BY user_id ORDER BY sha256(event_id::VARCHAR || '_42')) AS h,
        count(*) OVER (PARTITION BY user_id) AS size FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS mi FROM s
      WHERE size > 20 AND i >= size // 4 AND i < 3 * size // 4)
"""


def _sampled(spark, sf_dir, strategy):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("label")
    )
    return X.sample_per_cluster(rows, 20, strategy).select("id", "label")


@query(
    "sample_per_cluster",
    sql(SAMPLE_SQL, "SELECT id, label FROM s WHERE size >= 5 AND h <= 20"),
)
def sample_per_cluster(spark, sf_dir):
    return _sampled(spark, sf_dir, "random")


@query(
    "sample_per_cluster_spread",
    sql(SAMPLE_SQL, """SELECT id, label FROM s WHERE size >= 5 AND (size <= 20
        OR (i % (size // 20) = 0 AND i // (size // 20) < 20))"""),
)
def sample_per_cluster_spread(spark, sf_dir):
    return _sampled(spark, sf_dir, "spread")


@query(
    "sample_per_cluster_representative",
    sql(SAMPLE_SQL, """SELECT id, label FROM s WHERE size >= 5 AND (size <= 20 OR i < 6
          OR i >= size - 6) UNION SELECT id, label FROM m WHERE mi <= 8"""),
)
def sample_per_cluster_representative(spark, sf_dir):
    return _sampled(spark, sf_dir, "representative")
