"""Ranking of parameter sets: order lines summed up per flag (subject) and supplier (parameter)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.scalars import round_all
from strophe.operators import ranking as R
from strophe.plans.bindings import r6, sql
from strophe.plans.registry import query, table

METRICS = ["silhouette", "dbi", "nmi", "dunn"]
PARAMS = ["min_cluster_size", "min_samples"]


def scores(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rare = F.col("l_suppkey") % 7 == 0
    return lines.groupBy(
        F.col("l_returnflag").alias("subject"), F.col("l_suppkey").alias("param_id")
    ).agg(
        F.avg("l_discount").alias("silhouette"),
        F.avg("l_tax").alias("dbi"),
        F.avg(F.when(~rare, F.col("l_discount") * F.col("l_tax"))).alias("nmi"),
        F.max(F.lit(None).cast("double")).alias("dunn"),
        (F.max("l_linenumber") * 3 + F.count("*") % 10).cast("long").alias("n_syls"),
        F.sum("l_quantity").cast("long").alias("sample_size"),
        (F.first("l_suppkey") % 4 * 5 + 5).cast("long").alias("min_cluster_size"),
        (F.first("l_suppkey") % 3).cast("long").alias("min_samples"),
    )


SCORES_SQL = """
scores AS (
  SELECT l_returnflag AS subject, l_suppkey AS param_id, avg(l_discount) AS silhouette,
    avg(l_tax) AS dbi, avg(CASE WHEN l_suppkey % 7 <> 0 THEN l_discount * l_tax END) AS nmi,
    NULL::DOUBLE AS dunn, (max(l_linenumber) * 3 + count(*) % 10)::BIGINT AS n_syls,
    sum(l_quantity)::BIGINT AS sample_size, (l_suppkey % 4 * 5 + 5)::BIGINT AS min_cluster_size,
    (l_suppkey % 3)::BIGINT AS min_samples
  FROM lineitem GROUP BY l_returnflag, l_suppkey)
"""


def _norm(metric: str, window: str) -> str:
    top = f"max({metric}) OVER {window} - {metric}" if metric in R.LOWER else (
        f"{metric} - min({metric}) OVER {window}"
    )
    return (
        f"CASE WHEN min({metric}) OVER {window} = max({metric}) OVER {window} THEN 1 ELSE "
        f"({top}) / (max({metric}) OVER {window} - min({metric}) OVER {window}) END"
    )


BY_SUBJECT = "(PARTITION BY subject)"
NORM_SQL = "norm AS (SELECT *, " + ", ".join(
    f"{_norm(m, BY_SUBJECT)} AS n_{m}" for m in METRICS) + " FROM scores)"
COMPOSITE_SQL = """
comp AS (SELECT *, (coalesce(n_silhouette, 0) + coalesce(n_dbi, 0) + coalesce(n_nmi, 0)
                    + coalesce(n_dunn, 0)) / 4 AS composite_score FROM norm)
"""
POOL_SQL = """
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject
           ORDER BY composite_score DESC NULLS LAST, param_id) AS rank FROM comp) x
         WHERE rank <= 20)
"""


def composed(spark, sf_dir):
    return R.composite_score(scores(spark, sf_dir), METRICS, by=["subject"])


@query(
    "normalize_metric",
    sql(SCORES_SQL, NORM_SQL, "SELECT subject, param_id, " + ", ".join(
        r6(f"n_{m}", f"normalized_{m}") for m in METRICS) + " FROM norm"),
)
def normalize_metric(spark, sf_dir):
    out = R.normalize_metrics(scores(spark, sf_dir), METRICS, ["subject"])
    names = [f"normalized_{m}" for m in METRICS]
    return round_all(out.select("subject", "param_id", *names), names)


@query(
    "composite_score",
    sql(SCORES_SQL, NORM_SQL, COMPOSITE_SQL,
        f"SELECT subject, param_id, {r6('composite_score')} FROM comp"),
)
def composite_score(spark, sf_dir):
    out = composed(spark, sf_dir).select("subject", "param_id", "composite_score")
    return round_all(out, ["composite_score"])


@query(
    "composite_score_weighted",
    sql(SCORES_SQL, NORM_SQL, f"""SELECT subject, param_id,
        {r6('''(coalesce(n_silhouette, 0) * 2 + coalesce(n_dbi, 0) + coalesce(n_nmi, 0) * 0.5
          + coalesce(n_dunn, 0)) / 4.5 * CASE WHEN n_syls <= 22 THEN 1
          ELSE 0.8 * exp(-(n_syls - 22) / 5.0::DOUBLE) END''', 'composite_score')} FROM norm"""),
)
def composite_score_weighted(spark, sf_dir):
    out = R.composite_score(
        scores(spark, sf_dir), METRICS, {"silhouette": 2, "nmi": 0.5}, ["subject"], (22, 5.0)
    )
    return round_all(out.select("subject", "param_id", "composite_score"), ["composite_score"])


@query(
    "best_params",
    sql(SCORES_SQL, NORM_SQL, COMPOSITE_SQL, """
        SELECT 'composite' AS method, subject, param_id, rank FROM (SELECT *, row_number() OVER (
          PARTITION BY subject ORDER BY composite_score DESC, param_id) AS rank FROM comp) x
        WHERE rank <= 5
        UNION ALL
        SELECT 'dbi', subject, param_id, rank FROM (SELECT *, row_number() OVER (
          PARTITION BY subject ORDER BY dbi, param_id) AS rank FROM comp) x WHERE rank <= 5"""),
)
def best_params(spark, sf_dir):
    rows = composed(spark, sf_dir)
    parts = [
        R.best_params(rows, 5, m).select(F.lit(m).alias("method"), "subject", "param_id", "rank")
        for m in ("composite", "dbi")
    ]
    return parts[0].unionByName(parts[1])


def _rank_sql(metric: str) -> str:
    order = "DESC" if metric in R.HIGHER else "ASC"
    return (
        f"rank() OVER (PARTITION BY subject ORDER BY {metric} {order} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY subject, {metric}) - 1) / 2.0::DOUBLE"
    )


@query(
    "metric_ranks",
    sql(SCORES_SQL, "SELECT *, silhouette_rank + dbi_rank + nmi_rank + dunn_rank AS aggregate_rank"
        " FROM (SELECT subject, param_id, " + ", ".join(
            f"{_rank_sql(m)} AS {m}_rank" for m in METRICS) + " FROM scores) x"),
)
def metric_ranks(spark, sf_dir):
    out = R.metric_ranks(scores(spark, sf_dir), METRICS, ["subject"])
    return out.select("subject", "param_id", *[f"{m}_rank" for m in METRICS], "aggregate_rank")


@query(
    "master_summary",
    sql(SCORES_SQL, NORM_SQL, COMPOSITE_SQL, f"""SELECT {r6('composite_score')}, {r6('nmi')},
        {r6('silhouette')}, {r6('dbi')}, dunn, n_syls, subject, param_id, sample_size,
        min_cluster_size, min_samples FROM comp"""),
)
def master_summary(spark, sf_dir):
    out = R.master_summary(scores(spark, sf_dir), METRICS, by=["subject"])
    names = ["composite_score", "nmi", "silhouette", "dbi"]
    return round_all(out.drop(*[f"normalized_{m}" for m in METRICS]), names)


@query(
    "pool_across_subjects",
    sql(SCORES_SQL, NORM_SQL, COMPOSITE_SQL, POOL_SQL, """SELECT subject, param_id, rank,
        CASE WHEN param_id % 2 = 0 THEN sample_size ELSE (SELECT count(*) FROM lineitem
          WHERE l_returnflag = subject AND l_suppkey = param_id) END AS sample_size FROM pool"""),
)
def pool_across_subjects(spark, sf_dir):
    known = composed(spark, sf_dir).withColumn(
        "sample_size", F.when(F.col("param_id") % 2 == 0, F.col("sample_size"))
    )
    labels = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("subject"), F.col("l_suppkey").alias("param_id")
    )
    out = R.pool_across_subjects(known, 20, labels)
    return out.select("subject", "param_id", "rank", "sample_size")


BINS = (0, 3000, 5000, 5200, 20000, None)
BIN_SQL = """
bins AS (SELECT *, CASE WHEN sample_size > 0 AND sample_size <= 3000 THEN '0-3000'
    WHEN sample_size > 3000 AND sample_size <= 5000 THEN '3000-5000'
    WHEN sample_size > 5000 AND sample_size <= 5200 THEN '5000-5200'
    WHEN sample_size > 5200 AND sample_size <= 20000 THEN '5200-20000'
    WHEN sample_size > 20000 THEN '20000-inf' END AS size_bin FROM comp),
perf AS (SELECT size_bin, count(DISTINCT subject) AS n_subjects, count(*) AS n_combinations,
    avg(sample_size) AS avg_sample_size, avg(n_syls) AS avg_n_clusters,
    avg(silhouette) AS silhouette_mean, avg(nmi) AS nmi_mean, stddev_samp(silhouette)
    AS silhouette_std, stddev_samp(nmi) AS nmi_std FROM bins WHERE size_bin IS NOT NULL
    GROUP BY size_bin),
modes AS (SELECT size_bin,
    (SELECT min_cluster_size FROM bins b WHERE b.size_bin = perf.size_bin GROUP BY min_cluster_size
     ORDER BY count(*) DESC, min_cluster_size LIMIT 1) AS min_cluster_size_mode,
    (SELECT min_samples FROM bins b WHERE b.size_bin = perf.size_bin GROUP BY min_samples
     ORDER BY count(*) DESC, min_samples LIMIT 1) AS min_samples_mode FROM perf)
"""
PERF_DOUBLES = ["avg_sample_size", "avg_n_clusters", "silhouette_mean", "nmi_mean",
                "silhouette_std", "nmi_std"]


@query(
    "performance_by_size",
    sql(SCORES_SQL, NORM_SQL, COMPOSITE_SQL, BIN_SQL, f"""SELECT size_bin, n_subjects,
        n_combinations, {', '.join(r6(c) for c in PERF_DOUBLES)}, min_cluster_size_mode,
        min_samples_mode FROM perf JOIN modes USING (size_bin)"""),
)
def performance_by_size(spark, sf_dir):
    out = R.performance_by_size(composed(spark, sf_dir), ["silhouette", "nmi"], PARAMS, BINS)
    return round_all(out, PERF_DOUBLES)


@query(
    "recommend_by_size",
    sql(SCORES_SQL, NORM_SQL, COMPOSITE_SQL, BIN_SQL, f"""SELECT size_bin, n_subjects,
        min_cluster_size_mode::DOUBLE AS min_cluster_size, min_samples_mode::DOUBLE AS min_samples,
        {r6('nmi_mean')}, {r6('nmi_std')} FROM perf JOIN modes USING (size_bin)"""),
)
def recommend_by_size(spark, sf_dir):
    metrics = ["silhouette", "nmi"]
    perf = R.performance_by_size(composed(spark, sf_dir), metrics, PARAMS, BINS)
    out = R.recommend_by_size(perf, metrics, PARAMS)
    return round_all(
        out.select(
            "size_bin",
            "n_subjects",
            *[F.col("recommended")[p].alias(p) for p in PARAMS],
            F.col("expected")["nmi"]["mean"].alias("nmi_mean"),
            F.col("expected")["nmi"]["std"].alias("nmi_std"),
        ),
        ["nmi_mean", "nmi_std"],
    )


@query(
    "cross_subject_rank",
    sql(SCORES_SQL, NORM_SQL, COMPOSITE_SQL, POOL_SQL,
        "g AS (SELECT subject, param_id, " + ", ".join(
            f"{_norm(m, '()')} AS n_{m}" for m in METRICS) + " FROM pool)",
        f"""SELECT subject, param_id, {r6('c', 'composite_score')},
        rank() OVER (ORDER BY c DESC) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE
          AS cross_rank
        FROM (SELECT *, (coalesce(n_silhouette, 0) + coalesce(n_dbi, 0) + coalesce(n_nmi, 0)
              + coalesce(n_dunn, 0)) / 4 AS c FROM g) x"""),
)
def cross_subject_rank(spark, sf_dir):
    pool = R.pool_across_subjects(composed(spark, sf_dir), 20).drop(
        "composite_score", *[f"normalized_{m}" for m in METRICS]
    )
    out = R.cross_subject_rank(pool, METRICS)
    return round_all(
        out.select("subject", "param_id", "composite_score", "cross_rank"), ["composite_score"]
    )


@query(
    "score_matrix",
    sql(SCORES_SQL, NORM_SQL, " UNION ALL ".join(
        f"SELECT subject, param_id, '{m}' AS metric, {r6(f'n_{m}', 'value')} FROM norm"
        for m in METRICS)),
)
def score_matrix(spark, sf_dir):
    return round_all(R.score_matrix(scores(spark, sf_dir), METRICS, ["subject"]), ["value"])
