"""Queries that cluster the supplied embeddings, draw clouds, run a grid and replay episodes.

Results that hang on a random start have no SQL of their own; what every start must
give has: the sizes of drawn classes, and the groups of points that lie far apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.text import text_points
from pointloom.operators import graphs as G
from pointloom.operators import rl
from pointloom.operators.clustering import REGISTRY, cluster
from pointloom.operators.staging import stage
from pointloom.plans.base import RUNS_SQL, runs
from pointloom.plans.history import router_history
from pointloom.plans.point_queries import _EDGES, _edges, points
from pointloom.plans.relational_queries import even
from pointloom.plans.runner import Algorithm, expand, run_grid
from pointloom.sources.generators import GENERATORS, GRAPH_FEATURES, SHAPES, DataSpec, generate, karate_edges
from pointloom.sources.tables import table
from pointloom.streaming import windowed_values

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _cluster_query(algo: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        learned = {"history": router_history(spark, folder)} if algo.startswith("learned_router") else {}
        return cluster(points(spark, folder).select("point_id", "x"), algo, 5, 1, **learned).labels

    query.__doc__ = f"Labels of the embeddings by {algo}" + (", which has learned from the results." if algo.startswith("learned_router") else ".")
    return query


for _a in sorted(REGISTRY):
    QUERIES[f"cluster_{_a}"] = _cluster_query(_a)


def _generator_query(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = generate(spark, name, DataSpec(2000, 8, 3, 1.0, 1, outliers=20, noise=10))
        return df.groupBy("label_true").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"))

    query.__doc__ = f"Class sizes of a cloud of {name}."
    return query


for _g in GENERATORS:
    QUERIES[f"gen_{_g}"] = _generator_query(_g)

# Classes that a generator draws whatever it is asked for, and rows and dimensions where they aren't 2000 and 8.
_CLASSES = {"moons": 2, "circles": 2, "mixed_shapes": 5, "graph_karate": 2} | {name: k for name, (_, _, k) in SHAPES.items()}
_ROWS = {"graph_karate": 34} | {name: min(n, 2000) for name, (n, _, _) in SHAPES.items()}
_DIMS = {"ts_synth": 16, "ts_ecg200": 16, "ts_trace": 16, "graph_karate": GRAPH_FEATURES, "graph_sbm": GRAPH_FEATURES}
#: Generators whose classes are of random size: rows and classes are certain.
_UNEVEN = ("extreme_outliers", "imbalanced", "mdcgen")

for _g in GENERATORS:
    if _g not in _UNEVEN:
        _n, _k = _ROWS.get(_g, 2000), _CLASSES.get(_g, 3)
        SQL[f"gen_{_g}"] = f"SELECT i::INT AS label_true, {_n} // {_k} + (i < {_n % _k})::INT AS n, {_DIMS.get(_g, 8)} AS d FROM range({_k}) t(i) UNION ALL SELECT -1, 30, {_DIMS.get(_g, 8)}"


def gen_uneven(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, classes and added points of clouds whose classes are of random size."""
    found = None
    for name in _UNEVEN:
        sized = QUERIES[f"gen_{name}"](spark, folder)
        inner = F.when(F.col("label_true") >= 0, F.col("n"))
        one = sized.agg(F.sum("n").alias("n"), F.count(inner).alias("classes"), (F.min(inner) > 0).alias("none_empty"), F.max("d").alias("d")).withColumn("name", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


QUERIES["gen_uneven"] = gen_uneven
SQL["gen_uneven"] = "SELECT unnest(['extreme_outliers', 'imbalanced', 'mdcgen']) AS name, 2030 AS n, 3 AS classes, true AS none_empty, 8 AS d"


def separated(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings as points of three groups: four of their coordinates, moved far apart by id."""
    third = F.col("point_id") % 3
    x = [F.col("x")[i] + F.when((third == i) & (third > 0), 6.0).otherwise(0.0) for i in range(4)]
    return points(spark, folder).select("point_id", F.array(*x).alias("x"))


#: Kernels that may leave points of a group out as noise.
_NOISY = ("dbscan", "dbscan_auto", "learned_router_v6", "learned_router_v6b", "learned_router_v6c")
#: Kernels that don't look for round groups apart: linear subspaces, communities of a graph, an embedding that a graph in parts leaves open, modes at a width narrower than the groups, or the smallest valleys of all.
_OTHER = ("s5c", "louvain_knn", "aura_v2", "aura_v3", "meanshift_robust", "optics")


def _separated_query(algo: str):
    def whole(spark: SparkSession, folder: str) -> DataFrame:
        labels = cluster(separated(spark, folder), algo, 3, 1).labels
        first = labels.groupBy("label").agg(F.min("point_id").alias("first"))
        return labels.join(first, "label").select("point_id", "first")

    def noisy(spark: SparkSession, folder: str) -> DataFrame:
        labels = cluster(separated(spark, folder), algo, 3, 1).labels
        kept = F.when(F.col("label") >= 0, F.col("label"))
        sides = labels.groupBy((F.col("point_id") % 3).alias("third")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(kept).alias("clusters"), (F.count(kept) / F.count(F.lit(1)) > 0.9).alias("most"), F.min(kept).alias("label"))
        apart = sides.groupBy("label").agg(F.count(F.lit(1)).alias("thirds"))
        return sides.join(apart, "label").select("third", "n", "clusters", "most", "thirds")

    f = noisy if algo in _NOISY else whole
    f.__doc__ = f"Whether {algo} finds three groups that lie far apart: " + ("each mostly one cluster, no two the same." if algo in _NOISY else "each point with the first of its cluster.")
    return f


for _a in sorted(set(REGISTRY) - set(_OTHER)):
    QUERIES[f"separated_{_a}"] = _separated_query(_a)
    SQL[f"separated_{_a}"] = (
        "SELECT vec_id % 3 AS third, count(*) AS n, 1 AS clusters, true AS most, 1 AS thirds FROM embeddings GROUP BY 1"
        if _a in _NOISY
        else "SELECT vec_id AS point_id, min(vec_id) OVER (PARTITION BY vec_id % 3) AS first FROM embeddings"
    )


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_VOTES = "v AS (SELECT vec_id AS point_id, (vec_id % 3)::INT AS a, (vec_id % 4 % 3)::INT AS b, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE (vec_id % 2)::INT END AS c FROM embeddings)"


def _votes(spark, folder) -> DataFrame:
    i = F.col("point_id")
    return points(spark, folder).select("point_id", (i % 3).cast("int").alias("a"), (i % 4 % 3).cast("int").alias("b"), F.when(i % 5 == 0, -1).otherwise(i % 2).cast("int").alias("c"))


def vote_columns(df: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    """`label`: what most of the (weighted) columns say; noise counts only if all say so, the first of equals wins."""
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).alias("v"), F.lit(w).alias("w")) for i, (c, w) in enumerate(zip(columns, weights, strict=True))]))
    tally = df.select("point_id", spread.alias("s")).where("s.v >= 0").groupBy("point_id", F.col("s.v").alias("v")).agg(F.sum("s.w").alias("w"), F.min("s.at").alias("at"))
    best = tally.groupBy("point_id").agg(F.max_by("v", F.struct(F.round("w", 9), -F.col("at"))).alias("label"))
    return df.select("point_id").join(best, "point_id", "left").select("point_id", F.coalesce("label", F.lit(-1)).alias("label"))


def _vote_sql(w: tuple[float, float, float]) -> str:
    rows = " UNION ALL ".join(f"SELECT point_id, {c} AS v, {x}::DOUBLE AS w, {i} AS turn FROM v" for i, (c, x) in enumerate(zip("abc", w, strict=True)))
    return f"""WITH {_VOTES}, t AS (SELECT point_id, v, sum(w) AS w, min(turn) AS turn FROM ({rows}) WHERE v >= 0 GROUP BY point_id, v), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(w, 9) DESC, turn) AS place FROM t)
SELECT v.point_id, coalesce(r.v, -1) AS label FROM v LEFT JOIN r ON r.point_id = v.point_id AND r.place = 1"""


@query(_vote_sql((1.0, 1.0, 1.0)))
def consensus_vote(spark, folder):
    """Majority of three labellings."""
    return vote_columns(_votes(spark, folder), ["a", "b", "c"], [1.0, 1.0, 1.0])


@query(_vote_sql((0.5, 0.3, 0.25)))
def pwcc_vote(spark, folder):
    """Weighted vote of three labellings."""
    return vote_columns(_votes(spark, folder), ["a", "b", "c"], [0.5, 0.3, 0.25])


@query(f"""{RUNS_SQL}, hist AS (SELECT dataset, algo, avg(ari) AS ari, log10(avg(n_samples)) AS f0, avg(n_features) AS f1, avg(coalesce(k_target, 0)) AS f2 FROM runs WHERE ari IS NOT NULL GROUP BY dataset, algo), task AS (SELECT dataset, avg(f0) AS f0, avg(f1) AS f1, avg(f2) AS f2 FROM hist GROUP BY dataset),
d AS (SELECT a.dataset AS q, b.dataset AS t, round(sqrt(pow(a.f0 - b.f0, 2) + pow((a.f1 - b.f1) / 16, 2) + pow((a.f2 - b.f2) / 4, 2)), 9) AS dist FROM task a JOIN task b ON a.dataset <> b.dataset),
own AS (SELECT d.q, h.algo, h.ari, d.dist, row_number() OVER (PARTITION BY d.q, h.algo ORDER BY d.dist, d.t) AS place FROM d JOIN hist h ON h.dataset = d.t),
pred AS (SELECT q, algo, round(sum(ari / dist) / sum(1 / dist), 9) AS p FROM own WHERE place <= 5 GROUP BY q, algo), best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, algo) AS r FROM pred)
SELECT q AS dataset, algo AS choice, round(p + 1e-10, 6) AS expected FROM best WHERE r = 1""")
def router_knn_regress(spark, folder):
    """For each dataset the algorithm that neighbouring datasets' scores speak for, by distance-weighted regression."""
    hist, near = _history(spark, folder)
    from pyspark.sql import Window

    own = near.join(hist.select(F.col("dataset").alias("t"), "algo", "ari"), "t").withColumn("place", F.row_number().over(Window.partitionBy("q", "algo").orderBy("dist", "t"))).where("place <= 5")
    pred = own.groupBy("q", "algo").agg(F.round(F.sum(F.col("ari") / F.col("dist")) / F.sum(1 / F.col("dist")), 9).alias("p"))
    best = pred.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p"), "algo"))).where("r = 1")
    return best.select(F.col("q").alias("dataset"), F.col("algo").alias("choice"), even("p", 6).alias("expected"))


def _history(spark, folder) -> tuple[DataFrame, DataFrame]:
    df = runs(spark, folder, "dataset", "ari", "n_samples", "n_features", "k_target").where("ari is not null")
    hist = stage(df.groupBy("dataset", "algo").agg(F.avg("ari").alias("ari"), F.log10(F.avg("n_samples")).alias("f0"), F.avg("n_features").alias("f1"), F.avg(F.coalesce("k_target", F.lit(0))).alias("f2")), "history")
    task = hist.groupBy("dataset").agg(*[F.avg(f).alias(f) for f in ("f0", "f1", "f2")])
    other = task.select(F.col("dataset").alias("t"), *[F.col(f).alias(f"t{f}") for f in ("f0", "f1", "f2")])
    pair = task.join(other, F.col("dataset") != F.col("t"))  # listed datasets, a fixed and small table
    gap = lambda f, s: F.pow((F.col(f) - F.col(f"t{f}")) / s, F.lit(2.0))
    return hist, pair.select(F.col("dataset").alias("q"), "t", F.round(F.sqrt(gap("f0", 1.0) + gap("f1", 16.0) + gap("f2", 4.0)), 9).alias("dist"))


@query(f"""{RUNS_SQL}, hist AS (SELECT dataset, algo, avg(ari) AS ari, log10(avg(n_samples)) AS f0, avg(n_features) AS f1, avg(coalesce(k_target, 0)) AS f2 FROM runs WHERE ari IS NOT NULL GROUP BY dataset, algo), task AS (SELECT dataset, avg(f0) AS f0, avg(f1) AS f1, avg(f2) AS f2 FROM hist GROUP BY dataset),
d AS (SELECT a.dataset AS q, b.dataset AS t, round(sqrt(pow(a.f0 - b.f0, 2) + pow((a.f1 - b.f1) / 16, 2) + pow((a.f2 - b.f2) / 4, 2)), 9) AS dist FROM task a JOIN task b ON a.dataset <> b.dataset), near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS place FROM d),
place AS (SELECT dataset, algo, row_number() OVER (PARTITION BY dataset ORDER BY round(ari, 9) DESC, algo) - 1 AS r FROM hist), mean AS (SELECT n.q, p.algo, round(avg(p.r), 9) AS m FROM near n JOIN place p ON p.dataset = n.t WHERE n.place <= 5 GROUP BY n.q, p.algo),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY m, algo) AS b FROM mean) SELECT q AS dataset, algo AS choice, round(m + 1e-10, 6) AS mean_place FROM best WHERE b = 1""")
def router_knn_rank(spark, folder):
    """For each dataset the algorithm with the lowest mean place on the five nearest datasets."""
    from pyspark.sql import Window

    hist, near = _history(spark, folder)
    five = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("dist", "t"))).where("place <= 5")
    places = hist.select(F.col("dataset").alias("t"), "algo", (F.row_number().over(Window.partitionBy("dataset").orderBy(F.round("ari", 9).desc(), "algo")) - 1).alias("r"))
    mean = five.join(places, "t").groupBy("q", "algo").agg(F.round(F.avg("r"), 9).alias("m"))
    best = mean.withColumn("b", F.row_number().over(Window.partitionBy("q").orderBy("m", "algo"))).where("b = 1")
    return best.select(F.col("q").alias("dataset"), F.col("algo").alias("choice"), even("m", 6).alias("mean_place"))


#: Distances of all pairs: breadth first, a node entering once with its first distance.
_HOPS = f"""WITH RECURSIVE {_EDGES[5:]}, bfs(source, node, hops) USING KEY (source, node) AS (
  SELECT DISTINCT u, u, 0 FROM ways UNION SELECT b.source, w.v, min(b.hops) + 1 FROM bfs b JOIN ways w ON w.u = b.node LEFT JOIN recurring.bfs s ON s.source = b.source AND s.node = w.v WHERE s.hops IS NULL GROUP BY b.source, w.v)"""


@query(f"{_HOPS} SELECT source AS node, round(avg(hops) + 1e-10, 6) AS avg_path FROM bfs WHERE hops > 0 GROUP BY source")
def graph_avg_path(spark, folder):
    """Mean length of the shortest paths from each node of the graph of three neighbours of all embeddings."""
    return G.average_path(_edges(spark, folder)).withColumn("avg_path", even("avg_path", 6))


#: Numbers of shortest paths beside the distances; a node lies on those of a pair whose parts add up.
_PATHS = f"""WITH RECURSIVE {_EDGES[5:]}, bfs(source, node, hops, ways_to) USING KEY (source, node) AS (
  SELECT DISTINCT u, u, 0, 1.0::DOUBLE FROM ways UNION SELECT b.source, w.v, min(b.hops) + 1, sum(b.ways_to) FROM bfs b JOIN ways w ON w.u = b.node LEFT JOIN recurring.bfs s ON s.source = b.source AND s.node = w.v WHERE s.hops IS NULL GROUP BY b.source, w.v)"""


@query(f"""{_PATHS}, total AS (SELECT count(DISTINCT node)::DOUBLE AS n FROM bfs), among AS (SELECT a.node, sum(a.ways_to * b.ways_to / c.ways_to) AS part FROM bfs a JOIN bfs b ON b.source = a.node JOIN bfs c ON c.source = a.source AND c.node = b.node
WHERE a.hops > 0 AND b.hops > 0 AND a.hops + b.hops = c.hops GROUP BY a.node) SELECT node, round(coalesce(part, 0) / ((n - 1) * (n - 2)) + 1e-10, 6) AS betweenness FROM (SELECT DISTINCT node FROM bfs) LEFT JOIN among USING (node), total""")
def graph_betweenness(spark, folder):
    """Betweenness of the nodes of that graph."""
    return G.betweenness(_edges(spark, folder)).withColumn("betweenness", even("betweenness", 6))


@query()
def graph_node_features(spark, folder):
    """Sixteen features of the members of the karate club, the Laplacian coordinates without sign."""
    return G.node_features(karate_edges(spark)).select("node", *[F.round(F.col("x")[i], 6).alias(f"f{i}") for i in range(6)], *[F.round(F.abs(F.col("x")[i]), 6).alias(f"f{i}") for i in range(6, 16)])


@query()
def text_features(spark, folder):
    """Documents as points: weighted terms on eight axes."""
    return text_points(table(spark, folder, "documents"), "doc_id", "text", 8)


#: Moves that tell groups far apart from each other, and what they must be given.
_MOVES = {"kpp_init": {}, "density_partition": {"eps": 0.0}, "eigen_embed": {}, "medoid_swap": {"out": 0}}


@query("SELECT unnest(['kpp_init', 'density_partition', 'eigen_embed', 'medoid_swap']) AS move, (SELECT count(*) FROM embeddings) AS n, true AS apart, true AS legal, true AS ended")
def rl_moves(spark, folder):
    """What four moves of an episode do on groups that lie far apart: each cluster is of one group, the move was legal, and the episode ends in time."""
    rows = separated(spark, folder).orderBy("point_id").collect()  # an episode is over one matrix
    x = np.array([r["x"] for r in rows])
    group = np.array([r["point_id"] % 3 for r in rows])
    out = []
    for move, params in _MOVES.items():
        env = rl.Environment(x, 3, 1)
        legal = move in {a for a, _ in env.legal()} or env.state.centers is None and move == "medoid_swap"
        for action in ("kpp_init",) if move in ("medoid_swap", "eigen_embed") else ():
            env.step(action)
        state, _, done = env.step(move, **params)
        for _ in range(env.max_steps):
            if done:
                break
            _, _, done = env.step("update_centers")
        pure = all(len(set(group[state.labels == c].tolist())) == 1 for c in np.unique(state.labels[state.labels >= 0]))
        out.append((move, len(x), pure, legal, done))
    return spark.createDataFrame(out, "move string, n long, apart boolean, legal boolean, ended boolean")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value) + 1e-10, 6) AS mean, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    """Values per hour and kind of event; the same plan runs on a stream."""
    df = windowed_values(table(spark, folder, "events"), "ts", "event_type", "value")
    return df.withColumn("mean", even("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def run_small_grid(spark, folder):
    """A grid of two datasets, two seeds and four algorithms, run and scored."""
    tasks = expand({"datasets": ["blobs", "moons"], "n_samples": [200], "k": [3], "seeds": [1, 2]})
    out = run_grid(spark, tasks, [Algorithm(a) for a in ("kmeans", "gmm", "agglomerative", "dbscan_auto")])
    return out.results.select("algo", "dataset_id", "seed", "n_clusters_found", "n_steps", "ari", "nmi")


@query()
def rl_traces(spark, folder):
    """Five plans replayed on three drawn tasks."""
    tasks = spark.createDataFrame([("blobs", 150, 3, 3, 1), ("moons", 150, 2, 2, 2), ("circles", 150, 2, 2, 3)], "dataset string, n_samples int, n_features int, k int, seed int")
    return rl.collect_traces(spark, tasks)


