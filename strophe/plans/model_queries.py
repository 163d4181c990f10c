"""Multivariate reports over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.distributed import beside
from strophe.functions.scalars import round_all
from strophe.operators import features as X
from strophe.operators import models as M
from strophe.plans.bindings import r6, sql
from strophe.plans.feature_queries import FEATURES, anova_sql
from strophe.plans.registry import query, table


def keyed(spark, sf_dir):
    """Numeric columns of the lines, the hash of a line deciding its fold."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat("l_returnflag", "l_linestatus").alias("label"), *FEATURES,
        F.xxhash64(*rows.columns).alias("id"),
    )


@query("pca_report")
def pca_report(spark, sf_dir):
    loadings, tests = M.pca_report(keyed(spark, sf_dir), FEATURES, k=3)
    tested = tests.select(F.col("feature").alias("component"), "f_statistic", "p_value")
    return loadings.join(tested, "component")


@query("lda_report")
def lda_report(spark, sf_dir):
    coefficients, tests, accuracy = M.lda_report(keyed(spark, sf_dir), FEATURES)
    tested = tests.select(F.col("feature").alias("discriminant"), "f_statistic")
    joined = coefficients.join(tested, "discriminant")
    return beside(joined, accuracy.agg(F.avg("accuracy").alias("accuracy")))


COMPONENTS = [f"c{i}" for i in range(64)]
MIXED = "2 * embedding[{}] + embedding[{}]"


def mixtures(spark, sf_dir):
    """All components of the vectors; the label cuts a mixture of the first two into three."""
    mixed = F.expr(MIXED.format(0, 1))
    level = F.when(mixed < -0.1, "low").when(mixed > 0.1, "high").otherwise("mid")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        level.alias("label"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COMPONENTS)],
    )


MIXED_SQL = (
    f"""
mixed AS (SELECT vec_id, embedding, {MIXED.format(1, 2)} AS m FROM embeddings),
pts AS (SELECT vec_id AS id, CASE WHEN m < -0.1 THEN 'low' WHEN m > 0.1 THEN 'high' ELSE 'mid' END
          AS label, 'c' || unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS x FROM mixed),
mo AS (SELECT feature, label, count(*) AS n, avg(x) AS mean,
         sum(x * x) - count(*) * avg(x) ** 2 AS ss FROM pts GROUP BY ALL)""",
    anova_sql("an", "mo"),
)
TOP_SQL = "SELECT feature FROM an ORDER BY eta_squared DESC LIMIT 2"


@query(
    "forest_report",
    sql(*MIXED_SQL, f"""SELECT feature, {r6('f_statistic')}, feature IN ({TOP_SQL}) AS leads,
        true AS in_range, 1.0::DOUBLE AS total, true AS above_majority FROM an"""),
)
def forest_report(spark, sf_dir):
    """Statistics of every feature, and what holds for any good forest on this label."""
    rows = mixtures(spark, sf_dir)
    table_, scores = M.forest_report(rows, COMPONENTS, trees=100, depth=30, folds=5)
    shares = rows.groupBy("label").count().agg(
        (F.max("count") / F.sum("count")).alias("majority"))
    facts = beside(
        table_.withColumn("accuracy", F.lit(sum(scores) / len(scores))),
        beside(shares, table_.agg(F.round(F.sum("importance"), 6).alias("total"))),
    )
    found = facts.select(
        "feature",
        "f_statistic",
        (F.col("rank") <= 2).alias("leads"),
        F.col("importance").between(0, 1).alias("in_range"),
        "total",
        (F.col("accuracy") >= F.col("majority")).alias("above_majority"),
    )
    return round_all(found, ["f_statistic"])


@query("forest_importances")
def forest_importances(spark, sf_dir):
    return M.forest_importances(mixtures(spark, sf_dir), COMPONENTS, trees=100, depth=30)


def tops(spark, sf_dir):
    """The first two features by variance explained, by the forest and by the discriminant."""
    rows = mixtures(spark, sf_dir)
    tested = X.fdr(X.anova(rows, COMPONENTS))
    coefficients, _, accuracy = M.lda_report(rows, COMPONENTS)
    first = coefficients.where("discriminant = 'ld1'").select(
        "feature", F.abs("coefficient").alias("score")
    )

    def parts(trees):
        return [
            M.top_by(tested, "univariate", "eta_squared", 2),
            M.top_by(trees, "forest", "importance", 2),
            M.top_by(first, "lda", "score", 2),
        ]

    return rows, tested, accuracy, parts


@query("consensus", sql(*MIXED_SQL, f"SELECT feature, 3::BIGINT AS n_methods FROM ({TOP_SQL})"))
def consensus(spark, sf_dir):
    rows, _, _, parts = tops(spark, sf_dir)
    return M.consensus(parts(M.forest_importances(rows, COMPONENTS, trees=100, depth=30)))


@query(
    "recommend_features",
    sql(*MIXED_SQL, f"""SELECT row_number() OVER (ORDER BY feature)::INT AS rank, feature,
        'consensus' AS reason, 3.0::DOUBLE AS score, 0::INT AS redundancy,
        NULL::VARCHAR AS category FROM ({TOP_SQL})"""),
)
def recommend_features(spark, sf_dir):
    rows, tested, _, parts = tops(spark, sf_dir)
    trees = M.forest_importances(rows, COMPONENTS, trees=100, depth=30)
    pairs = X.high_correlations(X.correlations(rows, COMPONENTS), 0.8)
    return M.recommend_features(M.consensus(parts(trees)), tested, pairs, trees, 2)


@query(
    "compare_methods",
    sql(*MIXED_SQL, f"""SELECT method, 2::BIGINT AS n_features,
        (SELECT feature FROM an ORDER BY eta_squared DESC LIMIT 1) AS best_feature,
        method <> 'univariate' AS above_majority
        FROM (VALUES ('univariate'), ('forest'), ('lda')) v(method)"""),
)
def compare_methods(spark, sf_dir):
    rows, _, accuracy, parts = tops(spark, sf_dir)
    trees, scores = M.forest_report(rows, COMPONENTS, trees=100, depth=30, folds=5)
    hits = accuracy.agg(F.avg("accuracy")).first()[0]
    found = M.compare_methods(parts(trees), {"forest": sum(scores) / len(scores), "lda": hits})
    majority = rows.groupBy("label").count().agg(
        (F.max("count") / F.sum("count")).alias("majority"))
    return beside(found, majority).select(
        "method", "n_features", "best_feature",
        F.coalesce(F.col("accuracy") > F.col("majority"), F.lit(False)).alias("above_majority"),
    )
