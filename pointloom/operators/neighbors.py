"""Nearest neighbours, neighbours within a radius, and what is derived from them.

Points are (`point_id`, `x`: array of doubles). All-pairs work runs block against
block: points are packed into blocks of bounded size, every block visits every other
one as a single row holding both matrices, and what leaves a visit is already reduced
(the k best of each point, the neighbours within the radius). No pair of points is
ever a row of a shuffle unless it is a result.

Where only near points matter, blocks are made of points that lie near each other
(around pivots, in shells of like distance), and a block visits those blocks only that
the triangle inequality lets hold a point within its reach. In few dimensions or in
clustered data that leaves a number of visits that hardly grows with the table; where
all points are about as far from each other it leaves them all, and the result is the
same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.staging import discard, stage

#: Points per block: a visit holds a matrix of BLOCK x BLOCK distances.
BLOCK = 2000
#: Links that one task joins rather than rounds of the cluster.
SMALL_GRAPH = 1_000_000


def _packed(points: DataFrame, blocks: int) -> DataFrame:
    """One row per block: `b`, `ids`, `xs`."""
    at = F.pmod(F.xxhash64("point_id"), F.lit(blocks)).cast("int").alias("b")
    rows = points.select(at, F.struct("point_id", "x").alias("p")).groupBy("b").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return rows.select("b", F.col("ps.point_id").alias("ids"), F.col("ps.x").alias("xs"))


def visits(queries: DataFrame, points: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Each block of queries with each block of points: `q_ids`, `q_xs`, `ids`, `xs`; without `points`, of queries with themselves."""
    points = queries if points is None else points
    n = max(1, math.ceil(points.count() / block))
    nq = n if queries is points else max(1, math.ceil(queries.count() / block))
    right = _packed(points, n)
    left = _packed(queries, nq).withColumnsRenamed({"b": "q_b", "ids": "q_ids", "xs": "q_xs"})
    asked = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tasks = min(10_000, 2 * n)  # few bytes, much work: left to itself the engine would put all visits into one task
    return asked.repartition(tasks, "b").join(right.repartition(tasks, "b"), "b").select("q_ids", "q_xs", "ids", "xs")


#: Points that cells are made around at most, and shells of a cell at most before it is split by hash.
MAX_PIVOTS, SHELLS = 2000, 64
#: Blocks that a table is cut into at most; more points make larger blocks.
MAX_BLOCKS = 100_000


class Cells:
    """Points in blocks that lie near each other.

    `table` has a row per block: `b`, `ids`, `xs`, `c` (its pivot), `r_min` and `r_max`
    (least and greatest distance from the pivot). `pivots` are `MAX_PIVOTS` rows at most.
    The first `skip` coordinates are carried along and don't count.
    """

    def __init__(self, points: DataFrame, block: int = BLOCK, skip: int = 0):
        spark = points.sparkSession
        n = points.count()
        block = max(block, math.ceil(n / MAX_BLOCKS))
        wanted = min(MAX_PIVOTS, max(1, math.ceil(n / block)))
        if wanted == 1:  # one block, around nothing
            self.pivots = np.zeros((1, 1))
            whole = points.agg(F.sort_array(F.collect_list(F.struct("point_id", "x"))).alias("ps")).where(F.size("ps") > 0)
            nothing = F.lit(0.0)
            self.table = stage(whole.select(F.lit(0).cast("long").alias("b"), F.lit(0).alias("c"), nothing.alias("r_min"), nothing.alias("r_max"), F.col("ps.point_id").alias("ids"), F.col("ps.x").alias("xs")), "blocks")
            return
        chosen = points.select("x", "point_id").orderBy(F.xxhash64("point_id"), "point_id").limit(wanted).collect()
        self.pivots = _matrix([r["x"] for r in chosen])[:, skip:] if chosen else np.zeros((1, 0))
        around = spark.sparkContext.broadcast(self.pivots)

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    d = distances(_matrix(frame["x"])[:, skip:], around.value)
                    c = d.argmin(axis=1)
                    yield frame.assign(c=c.astype(np.int32), r=d[np.arange(len(c)), c])

        placed = stage(points.select("point_id", "x").mapInPandas(assign, "point_id long, x array<double>, c int, r double"), "placed")
        cuts = [i / SHELLS for i in range(1, SHELLS)]
        cells = placed.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.percentile_approx("r", F.array(*[F.lit(q) for q in cuts]), 1000).alias("cuts"))
        rank = F.size(F.filter("cuts", lambda q: q < F.col("r")))
        shells = F.least(F.lit(SHELLS), F.ceil(F.col("size") / block))
        shelled = placed.join(F.broadcast(cells), "c").withColumn("shell", F.floor(rank * shells / SHELLS).cast("int")).drop("cuts", "size")
        full = shelled.groupBy("c", "shell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))  # a row per shell of a cell
        at = F.struct("c", "shell", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int").alias("part"))
        rows = shelled.join(F.broadcast(full), ["c", "shell"]).groupBy(F.xxhash64(at).alias("b"), "c").agg(
            F.sort_array(F.collect_list(F.struct("point_id", "x"))).alias("ps"), F.min("r").alias("r_min"), F.max("r").alias("r_max")
        )
        self.table = stage(rows.select("b", "c", "r_min", "r_max", F.col("ps.point_id").alias("ids"), F.col("ps.x").alias("xs")), "blocks")

    def visits(self, reach: float | DataFrame) -> DataFrame:
        """Each block with each block that may hold a point within its reach: `q_ids`, `q_xs`, `ids`, `xs`.

        `reach` is a distance, or a table (`b`, `reach`) of one per block.
        """
        spark = self.table.sparkSession
        known = self.table.select("b", "c", "r_min", "r_max").toPandas()  # `MAX_BLOCKS` rows, and some, at most
        gap = distances(self.pivots, self.pivots)
        held = spark.sparkContext.broadcast((known["b"].to_numpy(), known["c"].to_numpy(), known["r_min"].to_numpy(), known["r_max"].to_numpy(), gap))

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b, c, low, high, gap = held.value
            for frame in frames:
                found = []
                for q_c, q_low, q_high, q_reach in zip(frame["c"], frame["r_min"], frame["r_max"], frame["reach"], strict=True):
                    far = np.where(c == q_c, np.maximum(low - q_high, q_low - high), np.maximum(gap[q_c][c] - q_high - high, np.maximum(low - gap[q_c][c] - q_high, q_low - gap[q_c][c] - high)))
                    found.append(b[far <= q_reach * (1 + 1e-9) + 1e-8])
                yield pd.DataFrame({"q_b": frame["b"], "near": found})

        asked = self.table.select("b", "c", "r_min", "r_max")
        asked = asked.withColumn("reach", F.lit(float(reach))) if not isinstance(reach, DataFrame) else asked.join(reach, "b")
        pairs = asked.mapInPandas(near, "q_b long, near array<long>").select("q_b", F.explode("near").alias("b"))
        tasks = min(10_000, 2 * max(1, len(known)))  # few bytes, much work: left to itself the engine would put all visits into one task
        left = self.table.select(F.col("b").alias("q_b"), F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"))
        both = pairs.repartition(tasks, "q_b").join(left.repartition(tasks, "q_b"), "q_b")
        return both.repartition(tasks, "b").join(self.table.select("b", "ids", "xs").repartition(tasks, "b"), "b").select("q_ids", "q_xs", "ids", "xs")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, by differences (no cancellation), a dimension at a time."""
    out = np.zeros((len(a), len(b)))
    step = max(1, 250_000 // max(1, len(b)))
    for i in range(0, len(a), step):
        part = out[i : i + step]
        for k in range(a.shape[1]):
            diff = a[i : i + step, k, None] - b[None, :, k]
            diff *= diff
            part += diff
        np.sqrt(part, out=part)
    return out


def _by_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and a bound on how wrong cancellation makes them."""
    mid = b.mean(axis=0) if len(b) else 0.0
    a, b = a - mid, b - mid
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = na[:, None] + nb[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0), 1e-11 * float(na.max(initial=0.0) + nb.max(initial=0.0)) + 1e-18


def _exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of some pairs of rows by differences, to nine places."""
    out = np.zeros(len(rows))
    for k in range(a.shape[1]):
        diff = a[rows, k] - b[cols, k]
        out += diff * diff
    return np.round(np.sqrt(out), 9)


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows are at most `eps` apart, to nine places: by a product, and by differences where that can't tell."""
    d, slack = _by_product(a, b)
    slack += 4e-9 * (eps + 1e-9)
    near = d <= eps * eps - slack
    rows, cols = np.nonzero(np.abs(d - eps * eps) <= slack)
    near[rows, cols] = _exact(a, b, rows, cols) <= eps
    return near


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column])


def knn(points: DataFrame, k: int, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(`i`, `j`, `d`, `rk`): the `k` nearest points of each query, itself aside, ties by id; distances to nine places.

    Without `queries` the points ask for each other: the k-th nearest within a point's
    own block bounds how far it need look.
    """
    itself = queries is None

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q_xs, ids, xs in zip(frame["q_ids"], frame["q_xs"], frame["ids"], frame["xs"], strict=True):
                q_ids, ids = np.asarray(q_ids), np.asarray(ids)
                a, b = _matrix(q_xs), _matrix(xs)
                guess, slack = _by_product(a, b)
                guess[q_ids[:, None] == ids[None, :]] = np.inf
                m = min(k, guess.shape[1])
                last = np.partition(guess, m - 1, axis=1)[:, m - 1 : m]
                rows, cols = np.nonzero((guess <= last + 2 * slack + 4e-9 * (np.sqrt(last) + 1e-9)) & np.isfinite(guess))  # the k nearest and what may tie with the last
                d = _exact(a, b, rows, cols)
                order = np.lexsort((ids[cols], d, rows))
                rows, cols, d = rows[order], cols[order], d[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                yield pd.DataFrame({"i": q_ids[rows[keep]], "j": ids[cols[keep]], "d": d[keep]})

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            far = []
            for xs in frame["xs"]:
                x = _matrix(xs)
                if len(x) <= k:
                    far.append(np.inf)
                    continue
                d, slack = _by_product(x, x)
                far.append(float(np.sqrt(np.partition(d, k, axis=1)[:, k].max() + slack)) + 1e-8)
            yield pd.DataFrame({"b": frame["b"], "reach": far})

    if itself:
        cells = Cells(points, block)
        met = cells.visits(cells.table.select("b", "xs").mapInPandas(own, "b long, reach double"))
    else:
        met = visits(queries, points, block)
    found = met.mapInPandas(visit, "i long, j long, d double")
    best = F.slice(F.sort_array(F.collect_list(F.struct("d", "j"))), 1, k)
    ranked = found.groupBy("i").agg(best.alias("near")).select("i", F.posexplode("near").alias("at", "n"))
    return ranked.select("i", F.col("n.j").alias("j"), F.col("n.d").alias("d"), (F.col("at") + 1).alias("rk"))


def within(points: DataFrame, eps: float, block: int = BLOCK) -> DataFrame:
    """(`i`, `j`): ordered pairs of different points at most `eps` apart."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q_xs, ids, xs in zip(frame["q_ids"], frame["q_xs"], frame["ids"], frame["xs"], strict=True):
                q_ids, ids = np.asarray(q_ids), np.asarray(ids)
                near = _near(_matrix(q_xs), _matrix(xs), eps)
                near &= q_ids[:, None] != ids[None, :]
                a, b = np.nonzero(near)
                yield pd.DataFrame({"i": q_ids[a], "j": ids[b]})

    return Cells(points, block).visits(eps).mapInPandas(visit, "i long, j long")


def local_outlier_factor(near: DataFrame) -> DataFrame:
    """(`i`, `lof`) from a `knn` table: mean reachability density of the neighbours over the point's own."""
    kdist = near.groupBy(F.col("i").alias("of")).agg(F.max("d").alias("kd"))
    reach = near.join(kdist, near["j"] == kdist["of"]).select("i", "j", F.greatest("d", "kd").alias("r"))
    lrd = reach.groupBy("i").agg((1.0 / (F.avg("r") + 1e-10)).alias("lrd"))
    theirs = lrd.select(F.col("i").alias("j"), F.col("lrd").alias("lrd_j"))
    return near.select("i", "j").join(theirs, "j").groupBy("i").agg(F.avg("lrd_j").alias("m")).join(lrd, "i").select("i", (F.col("m") / F.col("lrd")).alias("lof"))


#: Values of a curve that one task looks at.
CURVE = 1_000_000


def knee(curve: DataFrame, value: str, fallback: float = 1e-6) -> DataFrame:
    """(`eps`): the value of a sorted curve farthest below its chord after both axes are scaled to 0..1; the median plus `fallback` if the curve is flat.

    The curve (`i`, `value`) is sorted by ranges; how many values lie before a range
    gives each value its place, and every range its farthest one.
    """
    n, lo, hi, middle = curve.agg(F.count(value), F.min(value), F.max(value), F.median(value)).first()
    spark = curve.sparkSession
    if not n or not hi > lo:
        return spark.createDataFrame([(None if middle is None else float(middle) + fallback,)], "eps double")
    ranges = max(1, math.ceil(n / CURVE))
    v = F.col(value).cast("double")
    placed = stage(curve.select(v.alias("v"), F.col("i").cast("long").alias("i")).where("v is not null").repartitionByRange(ranges, "v", "i").withColumn("part", F.spark_partition_id()), "curve")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row per range
    before, at = {}, 0
    for part in sorted(sizes):
        before[part], at = at, at + sizes[part]

    def bent(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["v", "i"], kind="stable")
        place = before[int(frame["part"].iloc[0])] + np.arange(len(frame))
        gap = np.round(np.abs((frame["v"].to_numpy() - lo) / (hi - lo) - place / (n - 1)), 9)
        best = int(gap.argmax())
        return pd.DataFrame({"gap": [gap[best]], "place": [int(place[best])], "v": [float(frame["v"].iloc[best])]})

    far = placed.groupBy("part").applyInPandas(bent, "gap double, place long, v double")
    return far.agg(F.max_by("v", F.struct("gap", -F.col("place"))).alias("eps"))


def one_nn(points: DataFrame, labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """(`point_id`, `label`): the label of the nearest labelled point (`point_id`, `x`, `label`)."""
    near = knn(labelled.select("point_id", "x"), 1, points.select("point_id", "x"), block)
    return near.join(labelled.select(F.col("point_id").alias("j"), "label"), "j").select(F.col("i").alias("point_id"), "label")


def neighbour_counts(points: DataFrame, eps: float, block: int = BLOCK, cells: Cells | None = None) -> DataFrame:
    """(`node`, `n`): other points at most `eps` away."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q_xs, ids, xs in zip(frame["q_ids"], frame["q_xs"], frame["ids"], frame["xs"], strict=True):
                q_ids, ids = np.asarray(q_ids), np.asarray(ids)
                near = _near(_matrix(q_xs), _matrix(xs), eps)
                near &= q_ids[:, None] != ids[None, :]
                yield pd.DataFrame({"node": q_ids, "n": near.sum(axis=1)})

    return (cells or Cells(points, block)).visits(eps).mapInPandas(visit, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _stars(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links between nodes as (node, smallest node of its component), the smallest itself left out."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.setdefault(i, i)) != i:
            parent[i] = parent[p]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        ri, rj = root(i), root(j)
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
    return [(i, r) for i in list(parent) if (r := root(i)) != i]


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(`node`, `component`): the smallest node reachable from each node.

    Alternates, as in the large-star / small-star scheme, linking every neighbour to
    the smallest node around it, which halves path lengths; each round is staged, and
    partial minima are taken before the shuffle, so a hub is no single task's burden.
    Up to `SMALL_GRAPH` links are joined by a single task, to the same result.
    """
    link = edges.select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).where("u <> v").distinct()
    link = stage(link, "link")
    if link.count() <= SMALL_GRAPH:

        def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [f for f in frames if len(f)]
            if held:
                whole = pd.concat(held)
                yield pd.DataFrame(_stars(whole["u"].to_numpy(), whole["v"].to_numpy()), columns=["node", "component"])

        own = link.coalesce(1).mapInPandas(join, "node long, component long")
        return nodes.join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    before = None
    for _ in range(max_rounds):
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        last = link
        link = stage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "link")
        discard(last)
        now = tuple(link.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    own = link.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _links(points: DataFrame, eps: float, block: int) -> DataFrame:
    """(`i`, `j`, `inner`) of points whose first coordinate says whether they are core points.

    Of the links among core points a visit emits one per point, to the smallest of its
    component there, which joins the same points in at most two blocks' worth of rows;
    of a point that is none, its nearest-numbered core neighbour.
    """

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q_xs, ids, xs in zip(frame["q_ids"], frame["q_xs"], frame["ids"], frame["xs"], strict=True):
                q_ids, ids, a, b = np.asarray(q_ids), np.asarray(ids), _matrix(q_xs), _matrix(xs)
                near = _near(a[:, 1:], b[:, 1:], eps)
                near &= (b[:, 0] > 0)[None, :]
                inner = near & (a[:, 0] > 0)[:, None] & (q_ids[:, None] < ids[None, :])
                i, j = np.nonzero(inner)
                kept = _stars(q_ids[i], ids[j])
                edge = np.flatnonzero((a[:, 0] <= 0) & near.any(axis=1))
                beside = [int(ids[near[e]].min()) for e in edge]
                yield pd.DataFrame({"i": [p for p, _ in kept] + q_ids[edge].tolist(), "j": [q for _, q in kept] + beside, "inner": [True] * len(kept) + [False] * len(edge)})

    return Cells(points, block, 1).visits(eps).mapInPandas(visit, "i long, j long, inner boolean")


def dbscan(points: DataFrame, eps: float, min_samples: int = 5, block: int = BLOCK) -> DataFrame:
    """(`point_id`, `label`, `core`): density clusters, the smallest core point of a cluster naming it, -1 for noise.

    A point counts itself towards `min_samples`. A border point joins the cluster of
    its nearest-numbered core neighbour. Neighbours are counted in a first round of
    visits and linked in a second; pairs of points are never written out.
    """
    ids = points.select(F.col("point_id").alias("node"))
    core = stage(neighbour_counts(points, eps, block).where(F.col("n") + 1 >= min_samples).select("node"), "core")
    flagged = points.join(core.select(F.col("node").alias("point_id"), F.lit(1.0).alias("core")), "point_id", "left")
    marked = stage(flagged.select("point_id", F.concat(F.array(F.coalesce("core", F.lit(0.0))), "x").alias("x")), "marked")
    links = stage(_links(marked, eps, block), "links")
    part = stage(components(links.where("inner"), core), "part")
    border = links.where(~F.col("inner")).groupBy(F.col("i").alias("node")).agg(F.min("j").alias("j")).join(part.select(F.col("node").alias("j"), "component"), "j").select("node", F.col("component").alias("beside"))
    all_of = ids.join(part, "node", "left").join(border, "node", "left")
    return all_of.select(F.col("node").alias("point_id"), F.coalesce("component", "beside", F.lit(-1)).cast("long").alias("label"), F.col("component").isNotNull().alias("core"))
