"""Queries over point clouds: neighbours, density, measures and k-means, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import vectors as V
from pointloom.operators import graphs as G
from pointloom.operators import kmeans as K
from pointloom.operators import metrics as M
from pointloom.operators import neighbors as N
from pointloom.operators import series as T
from pointloom.operators.staging import stage
from pointloom.plans.relational_queries import even
from pointloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

D, EPS, NEAR = 64, 1.15, 10


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, folder: str) -> DataFrame:
    """The supplied embeddings as points with their true label."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"))


def _other(df: DataFrame) -> DataFrame:
    """A second labelling without chance: by id, a ninth being noise."""
    return df.withColumn("other", F.when(F.col("point_id") % 9 == 8, -1).otherwise(F.col("point_id") % 7).cast("int"))


def _knn(spark, folder, k=NEAR) -> DataFrame:
    return stage(N.knn(points(spark, folder), k), "knn")


_P = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label, CASE WHEN vec_id % 9 = 8 THEN -1 ELSE vec_id % 7 END::INT AS other FROM embeddings)"
_PAIRS = f"{_P}, pairs AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.x, b.x), 9) AS d, a.label AS la, b.label AS lb, a.other AS oa, b.other AS ob FROM pts a JOIN pts b ON a.id <> b.id)"
_KNN = f"{_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM pairs), knn AS (SELECT * FROM ranked WHERE rk <= {NEAR})"
_R = "round({} + 1e-10, 6)"


@query(f"WITH {_KNN} SELECT i, j, round(d, 6) AS d, rk::INT AS rk FROM knn")
def knn_graph(spark, folder):
    """Ten nearest neighbours of every point."""
    return _knn(spark, folder).select("i", "j", F.round("d", 6).alias("d"), "rk")


_CURVE = f"WITH {_KNN}, curve AS (SELECT i, d FROM knn WHERE rk = 4)"


@query(f"{_CURVE} SELECT row_number() OVER (ORDER BY d, i) AS place, round(d, 6) AS d FROM curve")
def knn_distance_curve(spark, folder):
    """Sorted distances to the fourth neighbour."""
    curve = T.positioned(_knn(spark, folder).where("rk = 4").select(F.lit(0).alias("all"), "d", "i"), "all", ["d", "i"], "d")
    return curve.select((F.col("pos") + 1).cast("long").alias("place"), F.round("v", 6).alias("d"))


_KNEE = f"""{_CURVE}, bent AS (SELECT d, row_number() OVER (ORDER BY d, i) AS pos, round(abs((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) - (row_number() OVER (ORDER BY d, i) - 1)::DOUBLE / (count(*) OVER () - 1)), 9) AS gap FROM curve)"""


@query(f"{_KNEE} SELECT round(d, 6) AS eps FROM bent ORDER BY gap DESC, pos LIMIT 1")
def dbscan_auto_eps(spark, folder):
    """Radius at the knee of that curve."""
    return N.knee(_knn(spark, folder).where("rk = 4"), "d").select(F.round("eps", 6).alias("eps"))


_LOF = f"""WITH {_KNN}, kd AS (SELECT i, max(d) AS kd FROM knn GROUP BY i), lrd AS (SELECT k.i, 1.0::DOUBLE / (avg(greatest(k.d, kd.kd)) + 1e-10) AS lrd FROM knn k JOIN kd ON k.j = kd.i GROUP BY k.i),
lof AS (SELECT k.i, avg(b.lrd) / any_value(a.lrd) AS lof FROM knn k JOIN lrd b ON k.j = b.i JOIN lrd a ON k.i = a.i GROUP BY k.i)"""


@query(f"{_LOF} SELECT i, {_R.format('lof')} AS lof FROM lof")
def lof_scores(spark, folder):
    """Local outlier factor of every point."""
    return N.local_outlier_factor(_knn(spark, folder)).select("i", even("lof", 6).alias("lof"))


@query(f"{_LOF.replace(f'rk <= {NEAR}', 'rk <= 20')} SELECT round(avg((lof > 1.5)::INT) + 1e-10, 6) AS share, round(avg((lof > 1.05)::INT) + 1e-10, 6) AS mild FROM lof")
def outlier_frac(spark, folder):
    """Share of points whose factor over twenty neighbours exceeds 1.5, and 1.05."""
    over = lambda b: even(F.avg((F.col("lof") > b).cast("int")), 6)
    return N.local_outlier_factor(_knn(spark, folder, 20)).agg(over(1.5).alias("share"), over(1.05).alias("mild"))


@query(f"{_LOF} SELECT i AS point_id, CASE WHEN row_number() OVER (ORDER BY round(lof, 9) DESC, i) <= (SELECT greatest(1, floor(count(*) * 0.05))::INT FROM lof) THEN -1 ELSE 0 END AS label FROM lof")
def outlier_trim(spark, folder):
    """The twentieth of the points with the highest factors as noise, by their places in ranges of the sorted table."""
    lof = N.local_outlier_factor(_knn(spark, folder)).select(F.lit(0).alias("all"), "i", (-F.round("lof", 9)).alias("low"))
    placed = T.positioned(lof, "all", ["low", "i"], "low", keep=["i"])
    cut = max(1, int(placed.count() * 0.05))
    return placed.select(F.col("i").alias("point_id"), F.when(F.col("pos") < cut, -1).otherwise(0).alias("label"))


@query(f"WITH {_KNN}, m AS (SELECT i, avg(d) AS m FROM knn GROUP BY i) SELECT {_R.format('stddev_pop(m) / avg(m)')} AS density_skew FROM m")
def density_skew(spark, folder):
    """Relative spread of the mean neighbour distance."""
    return _knn(spark, folder).groupBy("i").agg(F.avg("d").alias("m")).agg(even(F.stddev_pop("m") / F.avg("m"), 6).alias("density_skew"))


@query(f"WITH {_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM pairs) SELECT rk::INT AS k, {_R.format('avg(d)')} AS density FROM ranked WHERE rk IN (5, 20, 50) GROUP BY rk")
def density_multi_scale(spark, folder):
    """Mean distance to the 5th, 20th and 50th neighbour."""
    return _knn(spark, folder, 50).where("rk in (5, 20, 50)").groupBy(F.col("rk").alias("k")).agg(even(F.avg("d"), 6).alias("density"))


@query(f"WITH {_KNN}, t AS (SELECT i, max(CASE WHEN rk = 5 THEN d END) AS t5, max(CASE WHEN rk = 1 THEN d END) AS t1 FROM knn GROUP BY i) SELECT {_R.format('4.0::DOUBLE / avg(ln(t5 / t1))')} AS intrinsic_dim FROM t WHERE t1 > 0")
def intrinsic_dim(spark, folder):
    """Dimension by how neighbour distances grow."""
    t = _knn(spark, folder).groupBy("i").agg(F.max(F.when(F.col("rk") == 5, F.col("d"))).alias("t5"), F.max(F.when(F.col("rk") == 1, F.col("d"))).alias("t1"))
    return t.where("t1 > 0").agg(even(4.0 / F.avg(F.log(F.col("t5") / F.col("t1"))), 6).alias("intrinsic_dim"))


@query(f"WITH {_KNN}, p AS (SELECT i, avg((oa = ob)::INT) AS p FROM knn WHERE oa <> -1 GROUP BY i) SELECT {_R.format('avg(p)')} AS purity FROM p")
def kneighbor_purity(spark, folder):
    """Share of neighbours with the own label, noise aside."""
    labels = _other(points(spark, folder)).select("point_id", F.col("other").alias("label"))
    return M.neighbour_purity(_knn(spark, folder), labels).select(even("purity", 6).alias("purity"))


_EXT = """cells AS (SELECT label AS a, other AS b, count(*)::DOUBLE AS n FROM pts {w} GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n FROM cells GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM cells GROUP BY b), t AS (SELECT sum(n) AS n FROM cells),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS s, (SELECT sum(n * (n - 1) / 2) FROM ra) AS sa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS sb, n * (n - 1) / 2 AS st, n AS t FROM t),
h AS (SELECT (SELECT sum(c.n / t.n * ln(c.n * t.n / (ra.n * rb.n))) FROM cells c JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT -sum(ra.n / t.n * ln(ra.n / t.n)) FROM ra, t) AS ha, (SELECT -sum(rb.n / t.n * ln(rb.n / t.n)) FROM rb, t) AS hb)
SELECT round((s - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st) + 1e-10, 6) AS ari, round(mi / ((ha + hb) / 2) + 1e-10, 6) AS nmi FROM s, h"""


def _external(df: DataFrame) -> DataFrame:
    return M.external(df, "label", "other").select(even("ari", 6).alias("ari"), even("nmi", 6).alias("nmi"))


@query(f"WITH {_P}, {_EXT.format(w='')}")
def ari_nmi(spark, folder):
    """Agreement of two labellings, noise being a class."""
    return _external(_other(points(spark, folder)))


@query(f"WITH {_P}, {_EXT.format(w='WHERE other <> -1')}")
def ari_nmi_masked(spark, folder):
    """The same without noise."""
    return _external(_other(points(spark, folder)).where("other <> -1"))


@query(f"WITH {_P} SELECT label AS a, other AS b, count(*) AS n FROM pts GROUP BY 1, 2")
def contingency(spark, folder):
    """How often two labels meet."""
    return M.contingency(_other(points(spark, folder)), "label", "other")


@query(f"WITH {_P} SELECT {_R.format('avg((label = other)::INT)')} AS weight FROM pts WHERE label <> -1")
def purity_weight(spark, folder):
    """Share of points whose aligned label is the reference's."""
    return _other(points(spark, folder)).where("label <> -1").agg(even(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("weight"))


_CEN = f"""WITH {_P}, dims AS (SELECT other AS label, unnest(x) AS v, unnest(range({D})) AS k FROM pts), cdim AS (SELECT label, k, avg(v) AS v FROM dims GROUP BY label, k), cen AS (SELECT label, list(v ORDER BY k) AS c FROM cdim GROUP BY label),
far AS (SELECT p.id, p.other AS label, list_distance(p.x, c.c) AS d FROM pts p JOIN cen c ON p.other = c.label), spread AS (SELECT f.label, count(*) AS n, avg(d * d) AS mean_sq, avg(d) AS mean_d, sum(d * d) AS sum_sq, stddev_pop(d) / avg(d) AS cv, stddev_pop(d) AS sd FROM far f GROUP BY f.label)"""
_DB = "SELECT avg(w) AS db FROM (SELECT a.label, max((a.mean_d + b.mean_d) / list_distance(ca.c, cb.c)) AS w FROM spread a JOIN spread b ON a.label <> b.label JOIN cen ca ON ca.label = a.label JOIN cen cb ON cb.label = b.label {w} GROUP BY a.label)"


@query(f"""{_CEN} SELECT round((SELECT avg(mean_sq) FROM spread WHERE label <> -1 AND n > 1) + 1e-10, 6) AS compactness, round((SELECT sum(sum_sq) FROM spread WHERE label <> -1) + 1e-10, 6) AS inertia,
(SELECT count(*) FROM spread WHERE label <> -1) AS n_clusters_found, round((SELECT avg(pow(list_distance(a.c, b.c), 2)) FROM cen a JOIN cen b ON a.label <> b.label AND a.label <> -1 AND b.label <> -1) + 1e-10, 6) AS separation,
round(({_DB.format(w='')}) + 1e-10, 6) AS davies_bouldin""")
def internal_metrics(spark, folder):
    """Compactness, separation, inertia, number of clusters and Davies-Bouldin index."""
    df = _other(points(spark, folder)).select("point_id", "x", F.col("other").alias("label"))
    m = M.internal(df, D)
    return m.select("n_clusters_found", *[even(c, 6).alias(c) for c in ("compactness", "inertia", "separation", "davies_bouldin")])


@query(f"{_CEN} SELECT round(1.0::DOUBLE / (1.0::DOUBLE + ({_DB.format(w='WHERE a.label <> -1 AND b.label <> -1')})) + 1e-10, 6) AS db_inverse")
def db_inverse(spark, folder):
    """One over one plus the Davies-Bouldin index, noise aside."""
    df = _other(points(spark, folder)).where("other <> -1").select("point_id", "x", F.col("other").alias("label"))
    return M.internal(df, D).select(even(1.0 / (1.0 + F.col("davies_bouldin")), 6).alias("db_inverse"))


@query(f"""{_CEN}, g AS (SELECT list(v ORDER BY k) AS g FROM (SELECT k, avg(v) AS v FROM dims WHERE label <> -1 GROUP BY k)), s AS (SELECT sum(n) AS n, count(*) AS k, sum(sum_sq) AS w, sum(n * pow(list_distance(c.c, g.g), 2)) AS b FROM spread JOIN cen c USING (label), g WHERE spread.label <> -1)
SELECT round(b / (k - 1) / (w / (n - k)) + 1e-10, 6) AS calinski_harabasz FROM s""")
def calinski_harabasz(spark, folder):
    """Spread between over spread within clusters."""
    df = _other(points(spark, folder)).select("point_id", "x", F.col("other").alias("label"))
    return M.calinski_harabasz(df, D).select(even("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"{_CEN} SELECT label, round(cv + 1e-10, 6) AS cv, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.2::DOUBLE - 2 * cv)) + 1e-10, 6) AS convexity FROM spread")
def convexity_cv(spark, folder):
    """Relative spread of the distances to a cluster's centroid, and the convexity read from it."""
    s = M.to_centroid(_other(points(spark, folder)).select("point_id", "x", F.col("other").alias("label")), D)
    return s.select("label", even("cv", 6).alias("cv"), even(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.2 - 2 * F.col("cv"))), 6).alias("convexity"))


@query(f"{_CEN} SELECT f.label, round(avg((f.d <= s.sd)::INT) + 1e-10, 6) AS signature FROM far f JOIN spread s USING (label) GROUP BY f.label")
def shape_signature(spark, folder):
    """Share of a cluster's points nearer to the centroid than the deviation of the distances."""
    return M.shape_signature(_other(points(spark, folder)).select("point_id", "x", F.col("other").alias("label")), D).select("label", even("signature", 6).alias("signature"))


_SIL = f"""WITH {_PAIRS}, m AS (SELECT i, oa, ob, avg(d) AS m FROM pairs GROUP BY i, oa, ob), ab AS (SELECT i, oa, max(CASE WHEN oa = ob THEN m END) AS a, min(CASE WHEN oa <> ob THEN m END) AS b FROM m GROUP BY i, oa), s AS (SELECT i, oa, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query(f"{_SIL} SELECT oa AS label, round(avg(s) + 1e-10, 6) AS silhouette FROM s GROUP BY oa")
def silhouette(spark, folder):
    """Exact mean silhouette of every cluster."""
    df = _other(points(spark, folder)).select("point_id", "x", F.col("other").alias("label"))
    return M.silhouette_samples(df).join(df.select("point_id", "label"), "point_id").groupBy("label").agg(even(F.avg("silhouette"), 6).alias("silhouette"))


@query(f"WITH {_PAIRS} SELECT round(min(CASE WHEN oa <> ob THEN d END) / max(CASE WHEN oa = ob THEN d END) + 1e-10, 6) AS dunn FROM pairs WHERE oa <> -1 AND ob <> -1")
def dunn_index(spark, folder):
    """Least distance between over greatest within clusters."""
    return M.dunn(_other(points(spark, folder)).select("point_id", "x", F.col("other").alias("label"))).select(even("dunn", 6).alias("dunn"))


_EDGES = f"WITH {_KNN}, edges AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM knn WHERE rk <= 3), ways AS (SELECT i AS u, j AS v FROM edges UNION ALL SELECT j, i FROM edges)"


def _edges(spark, folder) -> DataFrame:
    return stage(G.undirected(_knn(spark, folder).where("rk <= 3")), "edges")


@query(f"""{_EDGES}, lab AS (SELECT e.i, e.j, a.other AS a, b.other AS b FROM edges e JOIN pts a ON a.id = e.i JOIN pts b ON b.id = e.j), deg AS (SELECT c, sum(w) AS w_in, count(*) AS deg FROM (SELECT a AS c, (a = b)::INT AS w FROM lab UNION ALL SELECT b, (a = b)::INT FROM lab) GROUP BY c)
SELECT round((sum(w_in) - sum(deg * deg)::DOUBLE / sum(deg)) / sum(deg) + 1e-10, 6) AS modularity FROM deg""")
def modularity(spark, folder):
    """Modularity of a labelling of the graph of three neighbours."""
    labels = _other(points(spark, folder)).select("point_id", F.col("other").alias("label"))
    return M.modularity(_edges(spark, folder).withColumn("weight", F.lit(1.0)), labels).select(even("modularity", 6).alias("modularity"))


@query(f"{_EDGES}, d AS (SELECT u AS node, count(*) AS degree FROM ways GROUP BY u) SELECT node, degree, round(degree::DOUBLE / (count(*) OVER () - 1) + 1e-10, 6) AS share FROM d")
def graph_degree(spark, folder):
    """Degree of every node of that graph."""
    return G.degrees(_edges(spark, folder)).withColumn("share", even("share", 6))


@query(f"""{_EDGES}, d AS (SELECT u AS node, count(*) AS degree FROM ways GROUP BY u), tri AS (SELECT a.u AS node, count(*) AS t FROM ways a JOIN ways b ON a.u = b.u AND a.v < b.v JOIN edges e ON e.i = a.v AND e.j = b.v GROUP BY a.u)
SELECT d.node, round(CASE WHEN degree < 2 THEN 0 ELSE coalesce(t, 0) / (degree * (degree - 1) / 2.0::DOUBLE) END + 1e-10, 6) AS coefficient FROM d LEFT JOIN tri USING (node)""")
def graph_clustering_coef(spark, folder):
    """Local clustering coefficient of every node."""
    return G.clustering_coefficients(_edges(spark, folder)).withColumn("coefficient", even("coefficient", 6))


_RANK_SQL = f"""WITH RECURSIVE {_EDGES[5:]}, deg AS (SELECT u, count(*)::DOUBLE AS deg FROM ways GROUP BY u), n AS (SELECT count(*)::DOUBLE AS n FROM deg),
r(node, r, turn) AS (SELECT u, 1 / n, 0 FROM deg, n UNION ALL SELECT w.v, any_value(0.15::DOUBLE / n.n) + 0.85::DOUBLE * sum(r.r / d.deg), any_value(r.turn) + 1 FROM r JOIN ways w ON w.u = r.node JOIN deg d ON d.u = w.u, n WHERE r.turn < 150 GROUP BY w.v)
SELECT node, round(r + 1e-10, 6) AS rank FROM r WHERE turn = 150"""


@query(_RANK_SQL)
def pagerank(spark, folder):
    """PageRank on that graph, run until a round changes less than 1e-9 in sum."""
    return G.pagerank(_edges(spark, folder), rounds=10_000).withColumn("rank", even("rank", 6))


_POWER_SQL = f"""WITH RECURSIVE {_EDGES[5:]}, nodes AS (SELECT DISTINCT u AS node FROM ways),
v(node, x, turn) AS (SELECT node, 1.0::DOUBLE / sqrt(count(*) OVER ()), 0 FROM nodes UNION ALL SELECT node, y / sqrt(sum(y * y) OVER ()), turn + 1 FROM (SELECT w.u AS node, sum(v.x) AS y, any_value(v.turn) AS turn FROM v JOIN ways w ON w.v = v.node WHERE v.turn < 3000 GROUP BY w.u))
SELECT node, round(abs(x) + 1e-10, 6) AS centrality FROM v WHERE turn = 3000"""


@query(_POWER_SQL)
def eigenvector_centrality(spark, folder):
    """Eigenvector centrality on that graph, run until a round changes less than 1e-9 in sum."""
    return G.eigenvector_centrality(_edges(spark, folder), rounds=10_000).withColumn("centrality", even("centrality", 6))


_SEEDS = ", ".join(f"c{i}" for i in range(5))


def _lloyd_sql(rounds: int, trim: float = 0.0, k: int = 5) -> str:
    parts = [f"WITH {_P}, cen0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS c FROM pts ORDER BY id LIMIT {k})"]
    for i in range(rounds):
        kept = f"asg{i}" if not trim else f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sq, id) AS place, count(*) OVER (PARTITION BY cid) AS size FROM asg{i}) WHERE place <= greatest(1, floor(size * {1 - trim}::DOUBLE)))"
        parts.append(f"asg{i} AS (SELECT id, x, label, arg_min(cid, (round(pow(list_distance(x, c), 2), 9), cid)) AS cid, min(pow(list_distance(x, c), 2)) AS sq FROM pts, cen{i} GROUP BY id, x, label)")
        parts.append(f"cen{i + 1} AS (SELECT cid, list(v ORDER BY dim) AS c FROM (SELECT cid, dim, avg(v) AS v FROM (SELECT cid, unnest(x) AS v, unnest(range({D})) AS dim FROM {kept}) GROUP BY cid, dim) GROUP BY cid)")
    parts.append(f"fin AS (SELECT id, label, arg_min(cid, (round(pow(list_distance(x, c), 2), 9), cid)) AS cid, min(pow(list_distance(x, c), 2)) AS sq FROM pts, cen{rounds} GROUP BY id, x, label)")
    return ", ".join(parts)


def _lloyd(spark, folder, trim: float = 0.0) -> tuple[DataFrame, K.Lloyd]:
    df = stage(points(spark, folder), "points")
    fit = K.lloyd(df, K.lowest_ids(df, 5), max_iter=3, tol=0.0, trim=trim)
    return df, fit


@query(f"{_lloyd_sql(3)} SELECT cid::INT AS cluster, count(*) AS n, round(sum(sq) + 1e-10, 6) AS inertia, round(avg(label) + 1e-10, 6) AS mean_label FROM fin GROUP BY cid")
def kmeans_lloyd(spark, folder):
    """Sizes and inertia of five clusters after three rounds from the lowest ids."""
    df, fit = _lloyd(spark, folder)
    found = K.assign(df, fit.centers).withColumnRenamed("label", "cluster").join(df.select("point_id", "label"), "point_id")
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), even(F.sum("sq"), 6).alias("inertia"), even(F.avg("label"), 6).alias("mean_label"))


@query(f"{_lloyd_sql(3)} " + " UNION ALL ".join(f"SELECT {i} AS step_idx, round(sum(sq) + 1e-10, 6) AS cost FROM asg{i}" for i in range(3)))
def kmeans_inertia_trace(spark, folder):
    """Cost of every round."""
    _, fit = _lloyd(spark, folder)
    rows = [(i, float(c)) for i, c, _ in fit.trace]
    return spark.createDataFrame(rows, "step_idx int, cost double").withColumn("cost", even("cost", 6))


@query(f"{_lloyd_sql(3, 0.1)} SELECT id AS point_id, cid::INT AS label FROM fin")
def kmeans_trimmed(spark, folder):
    """Labels after three rounds that leave each cluster's farthest tenth out of the means."""
    df, fit = _lloyd(spark, folder, 0.1)
    return K.assign(df, fit.centers).select("point_id", "label")


@query(f"""{_CEN}, near AS (SELECT p.id, arg_min(c.label, (round(list_distance(p.x, c.c), 9), c.label)) AS label FROM pts p, cen c WHERE c.label <> -1 GROUP BY p.id) SELECT id AS point_id, label FROM near""")
def assign_to_centers(spark, folder):
    """Every point to the nearest mean of a labelling."""
    df = points(spark, folder)
    labelled = _other(df).where("other <> -1").select("point_id", "x", F.col("other").alias("label"))
    rows = M.centroids(labelled, D).orderBy("label").collect()  # a row per label
    found = K.assign(df, np.array([r["c"] for r in rows]))
    names = F.array(*[F.lit(int(r["label"])) for r in rows])
    return found.select("point_id", F.element_at(names, F.col("label") + 1).alias("label"))


@query(f"""{_CEN}, pair AS (SELECT a.label AS a, b.label AS b, round(list_distance(a.c, b.c), 9) AS d FROM cen a JOIN cen b ON a.label < b.label WHERE a.label <> -1), best AS (SELECT a, b FROM pair ORDER BY d, a, b LIMIT 1)
SELECT p.id AS point_id, CASE WHEN p.other = best.b THEN best.a ELSE p.other END AS label FROM pts p, best""")
def ward_merge(spark, folder):
    """The two clusters with the nearest means as one."""
    df = _other(points(spark, folder)).select("point_id", "x", F.col("other").alias("label"))
    c = M.centroids(df.where("label <> -1"), D).select("label", "c")
    other = c.select(F.col("label").alias("b"), F.col("c").alias("cb"))
    best = c.join(other, F.col("label") < F.col("b")).select("label", "b", F.round(V.distance("c", "cb"), 9).alias("d")).orderBy("d", "label", "b").first()
    return df.select("point_id", F.when(F.col("label") == best["b"], best["label"]).otherwise(F.col("label")).alias("label"))


@query(f"WITH {_PAIRS}, near AS (SELECT i, arg_min(lb, (d, j)) AS label FROM pairs WHERE oa = -1 AND ob <> -1 GROUP BY i) SELECT i AS point_id, label FROM near")
def one_nn_assign(spark, folder):
    """Noise points to the true label of the nearest other point."""
    df = _other(points(spark, folder))
    return N.one_nn(df.where("other = -1"), df.where("other <> -1"))


_DB_SQL = f"""WITH RECURSIVE {_PAIRS}, near AS (SELECT i, j FROM pairs WHERE d <= {EPS}), core AS (SELECT p.id FROM pts p LEFT JOIN near n ON n.i = p.id GROUP BY p.id HAVING count(n.j) + 1 >= 5), link AS (SELECT i, j FROM near WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.j FROM reach r JOIN link l ON l.i = r.b), part AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a), border AS (SELECT n.i AS id, arg_min(p.c, n.j) AS c FROM near n JOIN part p ON p.id = n.j GROUP BY n.i)"""


@query(f"{_DB_SQL} SELECT p.id AS point_id, coalesce(part.c, border.c, -1) AS label, part.c IS NOT NULL AS core FROM pts p LEFT JOIN part ON part.id = p.id LEFT JOIN border ON border.id = p.id")
def dbscan_labels(spark, folder):
    """Density clusters at a fixed radius."""
    return N.dbscan(points(spark, folder), EPS)


@query(f"WITH {_P} SELECT id AS point_id, round(list_inner_product(x, [CASE WHEN k % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END FOR k IN range({D})]) + 1e-10, 6) AS p0, round(list_inner_product(x, [((k % 5) - 2) / 8.0::DOUBLE FOR k IN range({D})]) + 1e-10, 6) AS p1 FROM pts")
def random_projection(spark, folder):
    """Points projected by a given matrix of two columns."""
    columns = [[0.125 if k % 2 == 0 else -0.125 for k in range(D)], [((k % 5) - 2) / 8.0 for k in range(D)]]
    p = V.project("x", columns)
    return points(spark, folder).select("point_id", even(p[0], 6).alias("p0"), even(p[1], 6).alias("p1"))


_SERIES = "WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events WHERE value IS NOT NULL GROUP BY user_id), m AS (SELECT user_id, x, list_avg(x) AS mean, len(x) AS n FROM s), c AS (SELECT *, list_transform(x, lambda v: v - mean) AS y FROM m), v AS (SELECT *, list_sum(list_transform(y, lambda a: a * a)) / n AS var FROM c)"


def _series(spark, folder) -> DataFrame:
    return T.positioned(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value")


@query(f"""{_SERIES}, k AS (SELECT *, CASE WHEN var > 1e-12 THEN sqrt(var) ELSE 1.0 END AS sd FROM v) SELECT user_id, round(mean + 1e-10, 5) AS mean, round(sqrt(var) + 1e-10, 5) AS std, list_min(x) AS min, list_max(x) AS max, round(list_max(x) - list_min(x) + 1e-10, 5) AS range,
round(list_sum(list_transform(y, lambda a: a * a * a)) / n / pow(sd, 3) + 1e-10, 5) + 0.0::DOUBLE AS skew, round(list_sum(list_transform(y, lambda a: a * a * a * a)) / n / pow(sd, 4) - 3 + 1e-10, 5) + 0.0::DOUBLE AS kurtosis, round(list_sum(list_transform(y, lambda a: abs(a))) / n + 1e-10, 5) AS mad FROM k""")
def ts_stats(spark, folder):
    """Eight statistics of every user's series of values."""
    df = T.statistics(_series(spark, folder), "user_id")
    return df.select("user_id", *[(even(c, 5) if c not in ("min", "max") else F.col(c)).alias(c) for c in df.columns[1:]])


_LAGS = (1, 2, 5, 10)


@query(f"{_SERIES} SELECT user_id, " + ", ".join(f"round(CASE WHEN n <= {g} OR sqrt(list_sum(list_transform(y[1:n - {g}], lambda a: a * a)) / (n - {g})) * sqrt(list_sum(list_transform(y[{g + 1}:n], lambda a: a * a)) / (n - {g})) <= 1e-12 THEN 0 ELSE list_inner_product(y[1:n - {g}], y[{g + 1}:n]) / sqrt(list_sum(list_transform(y[1:n - {g}], lambda a: a * a)) * list_sum(list_transform(y[{g + 1}:n], lambda a: a * a))) END + 1e-10, 5) + 0.0::DOUBLE AS ac{g}" for g in _LAGS) + " FROM v")
def ts_autocorr(spark, folder):
    """Autocorrelation of every user's series at four lags."""
    df = T.autocorrelations(_series(spark, folder), "user_id", _LAGS)
    return df.select("user_id", *[even(f"ac{g}", 5).alias(f"ac{g}") for g in _LAGS])


@query(f"""{_SERIES}, t AS (SELECT *, CASE WHEN n > 1 THEN list_sum(list_transform(x, lambda v, i: (i - 1 - (n - 1) / 2.0::DOUBLE) * v)) / (n * (n::DOUBLE * n - 1) / 12) ELSE 0 END AS slope FROM v), r AS (SELECT user_id, n, list_transform(x, lambda v, i: v - mean - slope * (i - 1 - (n - 1) / 2.0::DOUBLE)) AS z FROM t)
SELECT user_id, """ + ", ".join(f"round(CASE WHEN {k} <= n // 2 THEN sqrt(pow(list_sum(list_transform(z, lambda v, i: v * cos(2 * pi() * {k} * (i - 1) / n))), 2) + pow(list_sum(list_transform(z, lambda v, i: v * sin(2 * pi() * {k} * (i - 1) / n))), 2)) ELSE 0 END + 1e-10, 4) AS f{k}" for k in range(4)) + " FROM r")
def ts_spectral(spark, folder):
    """First four Fourier magnitudes of every user's detrended series."""
    df = T.spectrum(_series(spark, folder), "user_id", 4)
    return df.select("user_id", *[even(f"f{k}", 4).alias(f"f{k}") for k in range(4)])


@query(f"""WITH {_P}, dims AS (SELECT unnest(x) AS v, unnest(range({D})) AS k FROM pts), sd AS (SELECT k, stddev_pop(v) AS sd FROM dims GROUP BY k) SELECT count(*) AS effective_rank FROM sd WHERE sd > 0.1 * (SELECT max(sd) FROM sd)""")
def effective_rank(spark, folder):
    """Dimensions whose deviation is more than a tenth of the greatest."""
    df = points(spark, folder).agg(F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(D)]).alias("sd"))
    return df.select(F.size(F.filter("sd", lambda v: v > 0.1 * F.array_max("sd"))).cast("long").alias("effective_rank"))


@query(f"{_CEN} SELECT c.label, s.n, round(list_sum(c.c) + 1e-10, 6) + 0.0::DOUBLE AS total FROM cen c JOIN spread s USING (label)")
def update_centers(spark, folder):
    """Mean of each label, shown by its size and the sum of its coordinates."""
    c = M.centroids(_other(points(spark, folder)).select("point_id", "x", F.col("other").alias("label")), D)
    return c.select("label", "n", even(V.total("c"), 6).alias("total"))


@query(f"""WITH RECURSIVE {_KNN}, e AS (SELECT round(median(d), 9) AS eps FROM knn WHERE rk = 5), near AS (SELECT i, j FROM pairs, e WHERE d <= eps), core AS (SELECT p.id FROM pts p LEFT JOIN near n ON n.i = p.id GROUP BY p.id HAVING count(n.j) + 1 >= 5),
link AS (SELECT i, j FROM near WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)), reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.j FROM reach r JOIN link l ON l.i = r.b), part AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
lab AS (SELECT p.id, part.c IS NOT NULL OR EXISTS (SELECT 1 FROM near n JOIN core ON core.id = n.j WHERE n.i = p.id) AS hit FROM pts p LEFT JOIN part ON part.id = p.id)
SELECT (SELECT count(DISTINCT c) FROM part) AS n_clusters, round(avg((NOT hit)::INT) + 1e-10, 6) AS noise_share FROM lab""")
def dbscan_probe(spark, folder):
    """Clusters and share of noise at the median distance to the fifth neighbour."""
    df = stage(points(spark, folder).select("point_id", "x"), "points")
    eps = N.knn(df, 5).where("rk = 5").agg(F.round(F.median("d"), 9)).first()[0]
    found = N.dbscan(df, eps, 5)
    return found.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), even(F.avg((F.col("label") < 0).cast("int")), 6).alias("noise_share"))
