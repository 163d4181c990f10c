"""Pedigree look-ups: customers are animals, nations colours, orders parent links."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import cohort as H
from strophe.operators import pedigree as D
from strophe.operators import phenotype as P
from strophe.plans.bindings import TOKEN_SQL, r6, sql
from strophe.plans.registry import query, table
from strophe.functions.scalars import round_all
from strophe.plans.sequence_queries import PARAMS
from strophe.plans.bindings import ENTROPY_SQL, event_sequence

ANIMAL_SQL = """
animals AS (SELECT 'u' || c_custkey AS uuid,
  CASE WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 3 = 1 THEN 'F' ELSE 'U' END AS sex,
  c_name AS hatch_date, c_mktsegment AS notes, c_nationkey AS band_color_id,
  CASE WHEN c_custkey % 4 > 0 THEN c_nationkey * 7 % 25 END AS band_color2_id,
  c_custkey % 100 AS band_number, CASE WHEN c_custkey % 4 > 0 THEN c_custkey // 100 END
  AS band_number2 FROM customer),
colors AS (SELECT n_nationkey AS id, chr(99 + n_nationkey // 5) || chr(97 + n_nationkey % 5)
  AS abbrv FROM nation),
links AS (SELECT DISTINCT 'u' || (o_orderkey * 13 % 1499) AS parent_id, 'u' || o_custkey AS child_id
  FROM orders),
band AS (SELECT uuid, a.abbrv || band_number || coalesce(b.abbrv, '') ||
  coalesce(band_number2::VARCHAR, '') AS band FROM animals LEFT JOIN colors a
  ON a.id = band_color_id LEFT JOIN colors b ON b.id = band_color2_id)
"""


def animals(spark, sf_dir):
    key = F.col("c_custkey")
    two = key % 4 > 0
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), key.cast("string")).alias("uuid"),
        F.when(key % 3 == 0, "M").when(key % 3 == 1, "F").otherwise("U").alias("sex"),
        F.col("c_name").alias("hatch_date"),
        F.col("c_mktsegment").alias("notes"),
        F.col("c_nationkey").alias("band_color_id"),
        F.when(two, F.col("c_nationkey") * 7 % 25).alias("band_color2_id"),
        (key % 100).alias("band_number"),
        F.when(two, F.floor(key / 100)).alias("band_number2"),
    )


def colors(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("id"),
        F.concat(F.char(99 + F.floor(key / 5)), F.char(97 + key % 5)).alias("abbrv"),
    )


def links(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("u"), (F.col("o_orderkey") * 13 % 1499).cast("string")).alias("parent_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("child_id"),
    ).distinct()


@query(
    "subjects_with_bands",
    sql(ANIMAL_SQL, """SELECT uuid, a.abbrv AS color1, band_number, b.abbrv AS color2, band_number2
        FROM animals JOIN colors a ON a.id = band_color_id JOIN colors b ON b.id = band_color2_id"""),
)
def subjects_with_bands(spark, sf_dir):
    return D.subjects_with_bands(animals(spark, sf_dir), colors(spark, sf_dir))


@query(
    "subject_uuid",
    sql(ANIMAL_SQL, """asked AS (SELECT band FROM band UNION SELECT 'zz' || n_nationkey || 'ca1'
          FROM nation)""",
        """SELECT asked.band, coalesce(min(b.uuid), 'nouuid') AS uuid, count(b.uuid) AS matches
           FROM asked LEFT JOIN band b ON b.band = asked.band GROUP BY asked.band"""),
)
def subject_uuid(spark, sf_dir):
    a, c = animals(spark, sf_dir), colors(spark, sf_dir)
    odd = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("zz"), F.col("n_nationkey").cast("string"), F.lit("ca1")).alias("band")
    )
    asked = D.band_of(a, c).select("band").union(odd).distinct()
    return D.subject_uuid(asked, a, c)


@query("band_of", sql(ANIMAL_SQL, "SELECT uuid, band FROM band"))
def band_of(spark, sf_dir):
    return D.band_of(animals(spark, sf_dir), colors(spark, sf_dir))


@query(
    "parents",
    sql(ANIMAL_SQL, """pp AS (SELECT child_id AS uuid, max(CASE WHEN sex = 'M' THEN parent_id END)
            AS father, max(CASE WHEN sex = 'F' THEN parent_id END) AS mother,
            max(CASE WHEN sex = 'M' THEN band END) AS f, max(CASE WHEN sex = 'F' THEN band END) AS m
          FROM links JOIN animals ON animals.uuid = parent_id JOIN band ON band.uuid = parent_id
          GROUP BY child_id)""",
        """SELECT animals.uuid, father, mother, coalesce(f, '?') || '_' || coalesce(m, '?')
           AS father_mother FROM animals LEFT JOIN pp USING (uuid)"""),
)
def parents(spark, sf_dir):
    a, c = animals(spark, sf_dir), colors(spark, sf_dir)
    return D.parents(a.select("uuid"), links(spark, sf_dir), a, D.band_of(a, c))


@query("offspring", sql(ANIMAL_SQL, "SELECT parent_id AS uuid, child_id FROM links"))
def offspring(spark, sf_dir):
    return D.offspring(links(spark, sf_dir))


@query(
    "common_offspring",
    sql(ANIMAL_SQL, """prs AS (SELECT 'u' || c_custkey AS a, 'u' || (c_custkey + 7) AS b
          FROM customer)""",
        """SELECT a, b, child_id FROM prs JOIN links x ON x.parent_id = a
           WHERE child_id IN (SELECT child_id FROM links y WHERE y.parent_id = b)"""),
)
def common_offspring(spark, sf_dir):
    key = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), key.cast("string")).alias("a"),
        F.concat(F.lit("u"), (key + 7).cast("string")).alias("b"),
    )
    return D.common_offspring(links(spark, sf_dir), pairs)


@query(
    "is_parent",
    sql(ANIMAL_SQL, "SELECT uuid FROM animals WHERE uuid IN (SELECT parent_id FROM links)"),
)
def is_parent(spark, sf_dir):
    return D.is_parent(animals(spark, sf_dir), links(spark, sf_dir)).select("uuid")


@query("attributes", sql(ANIMAL_SQL, "SELECT uuid, sex, hatch_date, notes FROM animals"))
def attributes(spark, sf_dir):
    return D.attributes(animals(spark, sf_dir))


@query(
    "append_note",
    sql(ANIMAL_SQL, """SELECT uuid, CASE WHEN s_suppkey IS NULL THEN notes ELSE notes || '_from_' ||
        'supplier' || '_' || s_name END AS notes FROM animals
        LEFT JOIN supplier ON 'u' || s_suppkey = uuid"""),
)
def append_note(spark, sf_dir):
    notes = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("uuid"),
        F.col("s_name").alias("note"), F.lit("supplier").alias("source"),
    )
    return D.append_note(animals(spark, sf_dir), notes).select("uuid", "notes")


def genetics(spark, sf_dir):
    allele = F.transform("embedding", lambda x: F.when(x > 0, "A").otherwise("G"))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("u"), F.col("vec_id").cast("string")).alias("uuid"),
        F.array_join(allele, ",").alias("snp"),
    )


@query(
    "snps",
    """SELECT 'u' || vec_id AS uuid, i - 1 AS locus, CASE WHEN embedding[i] > 0 THEN 'A' ELSE 'G' END
       AS allele FROM embeddings, range(1, 65) r(i)""",
)
def snps(spark, sf_dir):
    out = D.snps(genetics(spark, sf_dir))
    return out.withColumn("locus", F.col("locus").cast("long"))


@query(
    "snp_at",
    """SELECT 'u' || vec_id AS uuid, CASE WHEN embedding[11] > 0 THEN 'A' ELSE 'G' END AS allele
       FROM embeddings""",
)
def snp_at(spark, sf_dir):
    return D.snp_at(genetics(spark, sf_dir), 10)


def wide_expression(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("gene"), F.col("s_nationkey").cast("double").alias("u1"),
        F.col("s_acctbal").alias("u2"), (F.col("s_acctbal") * 2).alias("u3"),
    )


@query(
    "expression",
    """SELECT s_name AS gene, 'u1' AS subject, s_nationkey::DOUBLE AS value FROM supplier
       UNION ALL SELECT s_name, 'u2', s_acctbal FROM supplier
       UNION ALL SELECT s_name, 'u3', s_acctbal * 2 FROM supplier""",
)
def expression(spark, sf_dir):
    return D.expression(wide_expression(spark, sf_dir))


@query(
    "expression_of",
    "SELECT s_name AS gene, 'u2' AS subject, s_acctbal AS value FROM supplier WHERE s_suppkey = 3",
)
def expression_of(spark, sf_dir):
    return D.expression(wide_expression(spark, sf_dir), "Supplier#000000003", "u2")


@query(
    "cohort_table",
    sql(TOKEN_SQL, ENTROPY_SQL, f"""SELECT subject, 'new' AS run,
        (SELECT count(*) FROM voc v WHERE v.subject = ent.subject AND proportion > 0.02)
          AS repertoire_size, {r6('entropy')}, {r6('entropy_scaled')},
        (SELECT {r6('avg(value)', 'v')} FROM events WHERE user_id = ent.subject) AS mean_duration
        FROM ent"""),
)
def cohort_table(spark, sf_dir):
    rows = P.phenotype(event_sequence(spark, sf_dir), PARAMS).withColumn("rank", F.lit("manual"))
    old = rows.withColumns({"run": F.lit("old"), "run_at": F.lit(1), "entropy": F.lit(-1.0)})
    new = rows.withColumns({"run": F.lit("new"), "run_at": F.lit(2)})
    features = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.col("value").alias("duration")
    )
    out = H.cohort_table(old.unionByName(new), features, measures=["duration"])
    names = ["entropy", "entropy_scaled", "mean_duration"]
    return round_all(out.select("subject", "run", "repertoire_size", *names), names)
