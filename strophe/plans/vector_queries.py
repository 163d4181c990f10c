"""Vectors, neighbours, clusterings and scores over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import distances as D
from strophe.functions.scalars import round_all, rounded
from strophe.operators import clustering as C
from strophe.operators import metric_index as I
from strophe.operators import scores as K
from strophe.operators import vectors as V
from strophe.plans.bindings import r6, sql
from strophe.plans.registry import query, table


def vectors(spark, sf_dir):
    """Every fifty vectors are one song, every label one subject."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("subject"),
        F.floor(F.col("vec_id") / 50).cast("string").alias("song_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("string").alias("truth"),
    )


VECTOR_SQL = """
vecs AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS subject,
                CAST(vec_id // 50 AS VARCHAR) AS song_id, embedding::DOUBLE[] AS vec,
                CAST(label AS VARCHAR) AS truth FROM embeddings)
"""


@query(
    "load_vectors",
    sql(VECTOR_SQL, """SELECT id, subject, song_id,
        dense_rank() OVER (PARTITION BY subject ORDER BY song_id) - 1 AS song_index FROM vecs"""),
)
def load_vectors(spark, sf_dir):
    return V.load_vectors(vectors(spark, sf_dir)).select("id", "subject", "song_id", "song_index")


@query(
    "subsample_rows",
    "SELECT vec_id AS id FROM embeddings ORDER BY sha256(vec_id::VARCHAR || '_42') LIMIT 100",
)
def subsample_rows(spark, sf_dir):
    return V.subsample_rows(vectors(spark, sf_dir), 100).select("id")


@query(
    "subsample_rows_by",
    sql(VECTOR_SQL, """SELECT subject, id FROM vecs QUALIFY row_number() OVER (
        PARTITION BY subject ORDER BY sha256(id::VARCHAR || '_7')) <= 20"""),
)
def subsample_rows_by(spark, sf_dir):
    return V.subsample_rows(vectors(spark, sf_dir), 20, 7, by=["subject"]).select("subject", "id")


@query(
    "subsample_by_song",
    sql(
        VECTOR_SQL,
        """songs AS (SELECT subject, song_id, count(*) AS n, row_number() OVER (
             PARTITION BY subject ORDER BY sha256(song_id || '_42')) AS i
           FROM vecs GROUP BY subject, song_id),
        walk AS (
          SELECT subject, 0::BIGINT AS i, 0::BIGINT AS total, false AS take FROM songs
          GROUP BY subject
          UNION ALL
          SELECT s.subject, s.i,
            CASE WHEN (w.total = 0 OR w.total + s.n <= 30) AND w.total < 30 THEN w.total + s.n
                 ELSE w.total END,
            (w.total = 0 OR w.total + s.n <= 30) AND w.total < 30
          FROM walk w JOIN songs s ON s.subject = w.subject AND s.i = w.i + 1)""",
        """SELECT v.id, v.subject, v.song_id FROM vecs v
           JOIN songs s ON s.subject = v.subject AND s.song_id = v.song_id
           JOIN walk w ON w.subject = s.subject AND w.i = s.i WHERE w.take""",
        recursive=True,
    ),
)
def subsample_by_song(spark, sf_dir):
    kept = V.subsample_by_song(vectors(spark, sf_dir), 30)
    return kept.select("id", "subject", "song_id")


# consecutive vectors are compared; halves of a vector are real and imaginary part
DISTANCE_SQL = """
parts AS (SELECT a.id, a.vec AS v, b.vec AS w, a.vec[1:32] AS r1, a.vec[33:64] AS i1,
            b.vec[1:32] AS r2, b.vec[33:64] AS i2
          FROM vecs a JOIN vecs b ON b.id = a.id + 1),
cells AS (SELECT id, unnest(range(1, 33)) AS k, r1, i1, r2, i2 FROM parts),
polar AS (SELECT id, k, sqrt(r1[k]**2 + i1[k]**2) AS m1, sqrt(r2[k]**2 + i2[k]**2) AS m2,
            atan2(i1[k], r1[k]) AS p1, atan2(i2[k], r2[k]) AS p2 FROM cells),
aware AS (SELECT id, 1 - (0.8 * sum(m1 * m2) / (sqrt(sum(m1 * m1)) * sqrt(sum(m2 * m2)))
            + 0.2 * avg(cos(p1 - p2))) AS d FROM polar GROUP BY id),
grid AS (SELECT id, (k - 1) // 8 AS f, (k - 1) % 8 AS t, p1, p2 FROM polar),
stp AS (SELECT id, f, t, p1, p2,
          p1 - lag(p1) OVER w AS s1, p2 - lag(p2) OVER w AS s2
        FROM grid WINDOW w AS (PARTITION BY id, f ORDER BY t)),
wrap AS (SELECT id, f, t,
          CASE WHEN t = 0 THEN p1 ELSE s1 - 2 * pi() * floor((s1 + pi()) / (2 * pi())) END AS u1,
          CASE WHEN t = 0 THEN p2 ELSE s2 - 2 * pi() * floor((s2 + pi()) / (2 * pi())) END AS u2
        FROM stp),
unw AS (SELECT id, f, t, u1, u2, sum(u1) OVER w AS c1, sum(u2) OVER w AS c2 FROM wrap
        WINDOW w AS (PARTITION BY id, f ORDER BY t)),
inst AS (SELECT id, sqrt(sum((u1 - u2) ** 2)) AS d FROM unw WHERE t > 0 GROUP BY id),
gd AS (SELECT id, sqrt(sum(((c1 - n1) - (c2 - n2)) ** 2)) AS d FROM (
         SELECT id, c1, c2, lead(c1) OVER w AS n1, lead(c2) OVER w AS n2 FROM unw
         WINDOW w AS (PARTITION BY id, t ORDER BY f)) x WHERE n1 IS NOT NULL GROUP BY id)
"""


@query(
    "distance",
    sql(VECTOR_SQL, DISTANCE_SQL, f"""SELECT parts.id, {r6('list_distance(v, w)', 'euclidean')},
        {r6('sqrt(list_distance(r1, r2) ** 2 + list_distance(i1, i2) ** 2)', 'complex')},
        {r6('aware.d', 'phase_aware')}, {r6('gd.d', 'group_delay')}, {r6('inst.d', 'inst_freq')}
        FROM parts JOIN aware USING (id) JOIN gd USING (id) JOIN inst USING (id)"""),
)
def distance(spark, sf_dir):
    a = vectors(spark, sf_dir).select("id", "vec")
    b = a.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    half = [("r1", "vec", 1), ("i1", "vec", 33), ("r2", "w", 1), ("i2", "w", 33)]
    df = a.join(b, "id").withColumns({n: F.slice(F.col(c), s, 32) for n, c, s in half})
    rows = F.sequence(F.lit(0), F.lit(3))

    def grid(p):
        return F.transform(rows, lambda f: F.slice(p, f * 8 + 1, 8))

    df = df.withColumns({"p1": D.phase(F.col("r1"), F.col("i1")),
                         "p2": D.phase(F.col("r2"), F.col("i2"))})
    df = df.withColumns({"g1": grid(F.col("p1")), "g2": grid(F.col("p2"))})
    cols = [F.col(c) for c in ("r1", "i1", "r2", "i2")]
    return df.select(
        "id",
        rounded(D.euclidean(F.col("vec"), F.col("w"))).alias("euclidean"),
        rounded(D.complex_euclidean(*cols)).alias("complex"),
        rounded(D.phase_aware(*cols)).alias("phase_aware"),
        rounded(D.group_delay_distance(F.col("g1"), F.col("g2"))).alias("group_delay"),
        rounded(D.instantaneous_frequency_distance(F.col("g1"), F.col("g2"))).alias("inst_freq"),
    )


@query(
    "knn",
    sql(VECTOR_SQL, f"""SELECT id, neighbor, rank, {r6('d', 'distance')} FROM (
        SELECT a.id, b.id AS neighbor, list_distance(a.vec, b.vec) AS d,
          row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rank
        FROM vecs a JOIN vecs b ON a.id <> b.id) x WHERE rank <= 5"""),
)
def knn(spark, sf_dir):
    return round_all(I.knn(vectors(spark, sf_dir).select("id", "vec"), 5), ["distance"])


PAIRS = 3


def pair_sets(spark, sf_dir):
    """Point sets of neighbouring components: ``param_id, id, vec``."""
    sets = F.array(*[
        F.struct(
            F.lit(f"pair{i}").alias("param_id"),
            F.slice("embedding", 2 * i + 1, 2).cast("array<double>").alias("vec"),
        )
        for i in range(PAIRS)
    ])
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.explode(sets).alias("s"))
    return rows.select("s.param_id", "id", "s.vec")


def pair_grid(spark):
    return spark.createDataFrame(
        [(f"pair{i}", 2, False) for i in range(PAIRS)], "param_id string, k int, scale boolean"
    )


def embedded_pairs(spark, sf_dir):
    return V.embed_grid(pair_sets(spark, sf_dir), pair_grid(spark)).select(
        "param_id", "id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")
    )


# the axes of two columns in closed form; the larger entry of an axis is positive
EMBED_SQL = f"""
raw AS (SELECT 'pair' || i AS param_id, vec_id AS id, embedding[2 * i + 1]::DOUBLE AS u,
          embedding[2 * i + 2]::DOUBLE AS v FROM embeddings, range({PAIRS}) r(i)),
axis AS (SELECT param_id, avg(u) AS mu, avg(v) AS mv,
           atan2(2 * covar_pop(u, v), var_pop(u) - var_pop(v)) / 2 AS t FROM raw GROUP BY param_id),
way AS (SELECT *, sign(CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END) AS s1,
          sign(CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN -sin(t) ELSE cos(t) END) AS s2 FROM axis),
emb AS (SELECT param_id, id, s1 * ((u - mu) * cos(t) + (v - mv) * sin(t)) AS x,
          s2 * ((v - mv) * cos(t) - (u - mu) * sin(t)) AS y FROM raw JOIN way USING (param_id))
"""


@query("embed_pca", sql(EMBED_SQL, f"SELECT param_id, id, {r6('x')}, {r6('y')} FROM emb"))
def embed_pca(spark, sf_dir):
    return round_all(embedded_pairs(spark, sf_dir), ["x", "y"])


@query(
    "embed_pca_distances",
    sql(VECTOR_SQL, f"""SELECT a.id, {r6('list_distance(a.vec, b.vec)', 'distance')}
        FROM vecs a JOIN vecs b ON b.id = a.id + 1"""),
)
def embed_pca_distances(spark, sf_dir):
    """All 64 components keep the distances between rows."""
    out = V.embed_pca(vectors(spark, sf_dir).select("id", "vec"), 64).select("id", "embedding")
    after = out.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    gap = D.euclidean(F.col("embedding"), F.col("other"))
    return out.join(after, "id").select("id", rounded(gap).alias("distance"))


@query(
    "param_grid",
    """SELECT label AS subject, n AS n_rows, nn AS n_neighbors, md AS min_dist,
         mc AS min_cluster_size, ms AS min_samples,
         'n_neighbors=' || nn || '_min_dist=' || replace(md::VARCHAR, '.', 'p') ||
         '_min_cluster_size=' || mc || '_min_samples=' || ms AS param_id
       FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) e,
         (VALUES (5), (10), (20), (50), (100)) a(nn),
         (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.3), (0.5)) b(md), (VALUES (5), (20), (60)) c(mc),
         (VALUES (5), (15)) d(ms)
       WHERE nn < n""",
)
def param_grid(spark, sf_dir):
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("subject")).agg(
        F.count("*").alias("n_rows")
    )
    grid = V.param_grid(
        sizes,
        n_neighbors=[5, 10, 20, 50, 100],
        min_dist=[0.01, 0.05, 0.1, 0.3, 0.5],
        min_cluster_size=[5, 20, 60],
        min_samples=[5, 15],
    )
    return grid.where(F.col("n_neighbors") < F.col("n_rows"))


@query(
    "needs_recompute",
    """WITH want AS (SELECT label AS param_id, vec_id AS id FROM embeddings),
       have AS (SELECT label AS param_id, vec_id AS id FROM embeddings
                WHERE label < 5 OR (label < 8 AND embedding[1] > 0)),
       n AS (SELECT param_id, count(*) AS n_wanted,
         (SELECT count(*) FROM have h WHERE h.param_id = want.param_id) AS n_have,
         count(*) FILTER (EXISTS (SELECT 1 FROM have h
            WHERE h.param_id = want.param_id AND h.id = want.id)) AS n_shared
       FROM want GROUP BY param_id)
       SELECT param_id, n_wanted, nullif(n_have, 0) AS n_stored, n_shared,
         n_have <> n_wanted OR n_shared <> n_wanted AS recompute FROM n""",
)
def needs_recompute(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("param_id"), F.col("vec_id").alias("id"), "embedding"
    )
    have = rows.where("param_id < 5 OR (param_id < 8 AND embedding[0] > 0)").drop("embedding")
    return V.needs_recompute(have, rows.drop("embedding"))


@query(
    "embedding_inventory",
    """SELECT 'euclidean_' || label || 'neighbors_0.1dist_full' || count(*) AS param_id,
         'euclidean' AS metric, label AS n_neighbors, CAST(0.1 AS DOUBLE) AS min_dist,
         count(*)::INT AS "full", NULL::INT AS subsample, NULL::INT AS seed,
         count(*) AS n_original, count(*) FILTER (label < 5 OR embedding[1] > 0) AS n_rows,
         count(*) FILTER (label < 5 OR embedding[1] > 0) < count(*) AS subsampled
       FROM embeddings GROUP BY label""",
)
def embedding_inventory(spark, sf_dir):
    raw = table(spark, sf_dir, "embeddings")
    name = V.embedding_id(F.lit("euclidean"), F.col("label"), F.lit("0.1"), F.col("n_original"))
    params = raw.groupBy("label").agg(F.count("*").alias("n_original")).withColumn("param_id", name)
    stored = raw.where("label < 5 OR embedding[0] > 0").join(
        params.select("label", "param_id"), "label"
    )
    out = V.embedding_inventory(stored, params.drop("label"))
    return V.parse_embedding_id(out, "param_id")


@query("cluster_kmeans")
def cluster_kmeans(spark, sf_dir):
    rows = C.cluster_kmeans(vectors(spark, sf_dir).select("id", "vec"), 10)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"))


GRID_SQL = """
grid AS (SELECT * FROM (VALUES ('a', 0.02::DOUBLE, 4, 3), ('b', 0.03, 6, 10), ('c', 0.015, 2, 2))
         g(param_id, eps, min_samples, min_cluster_size))
"""
PLANE_SQL = """
pts AS (SELECT param_id, eps, min_samples, min_cluster_size, vec_id AS id,
          embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings, grid)
"""
SET_SQL = """
pts AS (SELECT emb.param_id || '/' || grid.param_id AS param_id, eps, min_samples,
          min_cluster_size, id, x, y FROM emb, grid)
"""
DENSITY_SQL = """
near AS (SELECT a.param_id, a.id, b.id AS other, a.min_samples FROM pts a JOIN pts b
         ON a.param_id = b.param_id
         AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= a.eps * a.eps),
core AS (SELECT param_id, id FROM near GROUP BY param_id, id, min_samples
         HAVING count(*) >= min_samples),
link AS (SELECT n.param_id, n.id, n.other FROM near n
         JOIN core a ON a.param_id = n.param_id AND a.id = n.id
         JOIN core b ON b.param_id = n.param_id AND b.id = n.other),
reach AS (SELECT param_id, id, id AS other FROM core
          UNION SELECT r.param_id, r.id, l.other FROM reach r
          JOIN link l ON l.param_id = r.param_id AND l.id = r.other),
comp AS (SELECT param_id, id, min(other) AS first_id FROM reach GROUP BY param_id, id),
kept AS (SELECT comp.param_id, first_id,
           row_number() OVER (PARTITION BY comp.param_id ORDER BY first_id) - 1 AS cluster
         FROM comp JOIN (SELECT DISTINCT param_id, min_cluster_size FROM pts) USING (param_id)
         GROUP BY comp.param_id, first_id, min_cluster_size
         HAVING count(*) >= min_cluster_size),
lab AS (SELECT pts.param_id, pts.id, x, y, coalesce(cluster, -1) AS cluster FROM pts
        LEFT JOIN comp ON comp.param_id = pts.param_id AND comp.id = pts.id
        LEFT JOIN kept ON kept.param_id = comp.param_id AND kept.first_id = comp.first_id)
"""


def plane(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )


def cut_grid(spark):
    return spark.createDataFrame(
        [("a", 0.02, 4, 3), ("b", 0.03, 6, 10), ("c", 0.015, 2, 2)],
        "cut_id string, eps double, min_samples int, min_cluster_size int",
    )


@query(
    "cluster_density",
    sql(GRID_SQL, PLANE_SQL, DENSITY_SQL, "SELECT id, cluster FROM lab WHERE param_id = 'a'", recursive=True),
)
def cluster_density(spark, sf_dir):
    points = plane(spark, sf_dir).withColumns(
        {"param_id": F.lit("a"), "eps": F.lit(0.02), "min_samples": F.lit(4),
         "min_cluster_size": F.lit(3)}
    )
    return C.cluster_density(points).select("id", "cluster")


@query(
    "grid_cluster",
    sql(GRID_SQL, PLANE_SQL, DENSITY_SQL, """SELECT param_id AS cut_id, cluster, count(*) AS n,
        min(id) AS first_id FROM lab GROUP BY param_id, cluster""", recursive=True),
)
def grid_cluster(spark, sf_dir):
    labels = C.grid_cluster(plane(spark, sf_dir), cut_grid(spark))
    return labels.groupBy("cut_id", "cluster").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id")
    )


@query(
    "embed_and_cluster",
    sql(GRID_SQL, EMBED_SQL, SET_SQL, DENSITY_SQL,
        "SELECT param_id, id, cluster FROM lab", recursive=True),
)
def embed_and_cluster(spark, sf_dir):
    """Every embedding of the grid cut by every row of the cluster grid."""
    labels = C.grid_cluster(embedded_pairs(spark, sf_dir), cut_grid(spark), ["param_id"])
    return labels.select(F.concat_ws("/", "param_id", "cut_id").alias("param_id"), "id", "cluster")


def labelled(spark, sf_dir):
    """Two labellings of the vectors: as given, and by the signs of two dimensions with noise."""
    signs = F.expr(
        "CASE WHEN abs(vec[1]) < 0.02 THEN '-1' ELSE concat(vec[0] > 0, vec[1] > 0) END"
    )
    both = F.array(
        F.struct(F.lit("given").alias("param_id"), F.col("truth").alias("label")),
        F.struct(F.lit("signs").alias("param_id"), signs.alias("label")),
    )
    return vectors(spark, sf_dir).select("id", "vec", "truth", F.explode(both).alias("l")).select(
        "id", "vec", "truth", "l.*"
    )


LABELLED_SQL = (
    VECTOR_SQL
    + """,
pts AS (SELECT 'given' AS param_id, id, vec, truth, truth AS label FROM vecs
        UNION ALL SELECT 'signs', id, vec, truth, CASE WHEN abs(vec[2]) < 0.02 THEN '-1'
          ELSE (vec[1] > 0)::VARCHAR || (vec[2] > 0)::VARCHAR END FROM vecs),
dims AS (SELECT param_id, id, label, unnest(range(1, 65)) AS k, unnest(vec) AS x FROM pts),
cen AS (SELECT param_id, label, k, avg(x) AS c FROM dims GROUP BY ALL),
siz AS (SELECT param_id, label, count(*) AS n FROM pts GROUP BY ALL),
dist AS (SELECT a.param_id, a.id, a.label, b.label AS other, list_distance(a.vec, b.vec) AS d
         FROM pts a JOIN pts b ON a.param_id = b.param_id AND a.id <> b.id)
"""
)
SCORE_SQL = {
    "silhouette": f"""SELECT param_id, {r6('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')}
        FROM (SELECT param_id, id, max(m) FILTER (same) AS a, min(m) FILTER (NOT same) AS b FROM (
          SELECT param_id, id, other = label AS same, other, avg(d) AS m FROM dist
          GROUP BY param_id, id, label, other) x GROUP BY param_id, id) y GROUP BY param_id""",
    "davies_bouldin": f"""SELECT param_id, {r6('avg(worst)', 'dbi')} FROM (
        SELECT a.param_id, a.label, max((a.s + b.s) / g.d) AS worst FROM spr a
        JOIN spr b ON a.param_id = b.param_id AND a.label <> b.label
        JOIN (SELECT x.param_id, x.label AS l1, y.label AS l2, sqrt(sum((x.c - y.c) ** 2)) AS d
              FROM cen x JOIN cen y ON x.param_id = y.param_id AND x.k = y.k AND x.label <> y.label
              GROUP BY ALL) g ON g.param_id = a.param_id AND g.l1 = a.label AND g.l2 = b.label
        GROUP BY a.param_id, a.label) z GROUP BY param_id""",
    "calinski_harabasz": f"""SELECT w.param_id,
        {r6('(b / (kk - 1)) / (w / (n - kk))', 'ch')} FROM
        (SELECT d.param_id, sum((x - c) ** 2) AS w FROM dims d JOIN cen ON cen.param_id = d.param_id
          AND cen.label = d.label AND cen.k = d.k GROUP BY d.param_id) w
        JOIN (SELECT c.param_id, sum(s.n * (c.c - g.g) ** 2) AS b FROM cen c
          JOIN siz s ON s.param_id = c.param_id AND s.label = c.label
          JOIN (SELECT param_id, k, avg(x) AS g FROM dims GROUP BY ALL) g
            ON g.param_id = c.param_id AND g.k = c.k GROUP BY c.param_id) b USING (param_id)
        JOIN (SELECT param_id, count(*) AS kk, sum(n) AS n FROM siz GROUP BY ALL) t
          USING (param_id)""",
    "dunn": f"""SELECT param_id, {r6('min(d) FILTER (label <> other) / max(d) FILTER (label = other)', 'dunn')}
        FROM dist WHERE label <> '-1' AND other <> '-1' GROUP BY param_id""",
}
SPREAD_SQL = """
spr AS (SELECT param_id, label, avg(d) AS s FROM (
          SELECT d.param_id, d.label, d.id, sqrt(sum((x - c) ** 2)) AS d FROM dims d
          JOIN cen ON cen.param_id = d.param_id AND cen.label = d.label AND cen.k = d.k
          GROUP BY d.param_id, d.label, d.id) z GROUP BY param_id, label)
"""
CRITERIA_SQL = """
crit AS (SELECT param_id, -w / (2 * n) AS ll, kk, n FROM
  (SELECT d.param_id, sum((x - c) ** 2) AS w FROM dims d JOIN cen ON cen.param_id = d.param_id
     AND cen.label = d.label AND cen.k = d.k WHERE d.label <> '-1' GROUP BY d.param_id) w
  JOIN (SELECT param_id, count(*) FILTER (label <> '-1') AS kk, sum(n) AS n FROM siz GROUP BY ALL) t
    USING (param_id))
"""
CONTINGENCY_SQL = """
cell AS (SELECT param_id, truth AS t, label AS p, count(*) AS n FROM pts GROUP BY ALL),
tot AS (SELECT param_id, sum(n)::DOUBLE AS n FROM cell GROUP BY ALL),
rw AS (SELECT param_id, t, sum(n)::DOUBLE AS n FROM cell GROUP BY ALL),
cl AS (SELECT param_id, p, sum(n)::DOUBLE AS n FROM cell GROUP BY ALL),
mi AS (SELECT c.param_id, sum(c.n / tot.n * ln(c.n * tot.n / (rw.n * cl.n))) AS mi FROM cell c
       JOIN tot USING (param_id) JOIN rw ON rw.param_id = c.param_id AND rw.t = c.t
       JOIN cl ON cl.param_id = c.param_id AND cl.p = c.p GROUP BY c.param_id),
ht AS (SELECT rw.param_id, sum(-rw.n / tot.n * ln(rw.n / tot.n)) AS h FROM rw
       JOIN tot USING (param_id) GROUP BY rw.param_id),
hp AS (SELECT cl.param_id, sum(-cl.n / tot.n * ln(cl.n / tot.n)) AS h FROM cl
       JOIN tot USING (param_id) GROUP BY cl.param_id),
ar AS (SELECT tot.param_id, tot.n * (tot.n - 1) / 2 AS al,
   (SELECT sum(n * (n - 1) / 2) FROM cell WHERE cell.param_id = tot.param_id) AS bo,
   (SELECT sum(n * (n - 1) / 2) FROM rw WHERE rw.param_id = tot.param_id) AS a,
   (SELECT sum(n * (n - 1) / 2) FROM cl WHERE cl.param_id = tot.param_id) AS b FROM tot),
nmi AS (SELECT mi.param_id, mi.mi / ((ht.h + hp.h) / 2) AS nmi FROM mi JOIN ht USING (param_id)
        JOIN hp USING (param_id)),
ari AS (SELECT param_id, (bo - a * b / al) / ((a + b) / 2 - a * b / al) AS ari FROM ar)
"""


@query("silhouette", sql(LABELLED_SQL, SCORE_SQL["silhouette"]))
def silhouette(spark, sf_dir):
    return round_all(K.silhouette(labelled(spark, sf_dir), ["param_id"]), ["silhouette"])


@query(
    "silhouette_fast",
    sql(LABELLED_SQL, """sq AS (SELECT param_id, id, label, other, sum(d * d) AS s, count(*) AS m
          FROM dist GROUP BY ALL),
        ab AS (SELECT sq.param_id, id,
            max(s / (siz.n - 1)) FILTER (sq.label = other) AS a,
            min(s / siz.n) FILTER (sq.label <> other) AS b
          FROM sq JOIN siz ON siz.param_id = sq.param_id AND siz.label = sq.other
          GROUP BY sq.param_id, id)""",
        f"SELECT param_id, {r6('avg((b - a) / greatest(a, b))', 'silhouette_fast')} FROM ab GROUP BY ALL"),
)
def silhouette_fast(spark, sf_dir):
    return round_all(K.silhouette_fast(labelled(spark, sf_dir), ["param_id"]), ["silhouette_fast"])


@query("davies_bouldin", sql(LABELLED_SQL, SPREAD_SQL, SCORE_SQL["davies_bouldin"]))
def davies_bouldin(spark, sf_dir):
    return round_all(K.davies_bouldin(labelled(spark, sf_dir), ["param_id"]), ["dbi"])


@query("calinski_harabasz", sql(LABELLED_SQL, SCORE_SQL["calinski_harabasz"]))
def calinski_harabasz(spark, sf_dir):
    return round_all(K.calinski_harabasz(labelled(spark, sf_dir), ["param_id"]), ["ch"])


@query("dunn", sql(LABELLED_SQL, SCORE_SQL["dunn"]))
def dunn(spark, sf_dir):
    return round_all(K.dunn(labelled(spark, sf_dir), ["param_id"]), ["dunn"])


@query(
    "information_criteria",
    sql(LABELLED_SQL, CRITERIA_SQL, f"""SELECT param_id, {r6('ll', 'log_likelihood')},
        {r6('2 * kk - 2 * ll', 'aic')}, {r6('ln(n) * kk - 2 * ll', 'bic')} FROM crit"""),
)
def information_criteria(spark, sf_dir):
    out = K.information_criteria(labelled(spark, sf_dir), ["param_id"])
    return round_all(out, ["log_likelihood", "aic", "bic"])


@query("nmi", sql(LABELLED_SQL, CONTINGENCY_SQL, f"SELECT param_id, {r6('nmi')} FROM nmi"))
def nmi(spark, sf_dir):
    return round_all(K.nmi(labelled(spark, sf_dir), ["param_id"]), ["nmi"])


@query("ari", sql(LABELLED_SQL, CONTINGENCY_SQL, f"SELECT param_id, {r6('ari')} FROM ari"))
def ari(spark, sf_dir):
    return round_all(K.ari(labelled(spark, sf_dir), ["param_id"]), ["ari"])


def _scores_sql() -> str:
    return sql(
        LABELLED_SQL, SPREAD_SQL, CRITERIA_SQL, CONTINGENCY_SQL,
        f"s1 AS ({SCORE_SQL['silhouette']})", f"s2 AS ({SCORE_SQL['davies_bouldin']})",
        f"s3 AS ({SCORE_SQL['calinski_harabasz']})", f"s4 AS ({SCORE_SQL['dunn']})",
        f"""SELECT param_id, 'silhouette' AS metric, silhouette AS value FROM s1
        UNION ALL SELECT param_id, 'dbi', dbi FROM s2 UNION ALL SELECT param_id, 'ch', ch FROM s3
        UNION ALL SELECT param_id, 'dunn', dunn FROM s4
        UNION ALL SELECT param_id, 'log_likelihood', {r6('ll', 'v')} FROM crit
        UNION ALL SELECT param_id, 'aic', {r6('2 * kk - 2 * ll', 'v')} FROM crit
        UNION ALL SELECT param_id, 'bic', {r6('ln(n) * kk - 2 * ll', 'v')} FROM crit
        UNION ALL SELECT param_id, 'nmi', {r6('nmi', 'v')} FROM nmi
        UNION ALL SELECT param_id, 'ari', {r6('ari', 'v')} FROM ari""",
    )


@query("all_scores", _scores_sql())
def all_scores(spark, sf_dir):
    return round_all(K.all_scores(labelled(spark, sf_dir), ["param_id"]), ["value"])
