"""Splits that keep related records together (problem 5)."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.neighbors import components
from pointloom.operators.skew import join_by_weight
from pointloom.operators.staging import stage

#: Equal bins that are dealt to the splits whole: shares are met to about half of 1 / BINS.
BINS = 1000
#: Groups balanced by one task, and bin rows merged by one task.
PER_TASK, FAN_IN = 20_000, 32


def largest_differencing(rows: Sequence[np.ndarray], singles: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Slot (0 .. k-1) of each entry of `rows`, arrays of k weights each, and of each of `singles`, such that the slots' sums are nearly equal.

    Entries of one row get different slots; one of weight 0 gets none (-1). Whatever
    differs most within itself (a single weight differs from nothing by all of it) is
    combined with what differs second most, the heaviest entries of the one with the
    lightest of the other, again and again, until one row is left.
    """
    base = k * len(rows) + len(singles)
    left: list[int] = []
    right: list[int] = []
    queue: list[tuple] = []
    for i, w in enumerate(rows):
        order = np.argsort(-w, kind="stable")
        v = w[order].astype(float)
        queue.append((v[-1] - v[0], i, v - v[-1], np.where(w[order] > 0, i * k + order, -1)))
    queue += [(-float(w), len(rows) + i, None, k * len(rows) + i) for i, w in enumerate(singles)]
    heapq.heapify(queue)
    turn = len(queue)

    def row(item: tuple) -> tuple[np.ndarray, np.ndarray]:
        if item[2] is not None:
            return item[2], item[3]
        v, n = np.zeros(k), np.full(k, -1)
        v[0], n[0] = -item[0], item[3]
        return v, n

    while len(queue) > 1:
        a, b = heapq.heappop(queue), heapq.heappop(queue)
        if a[2] is None or b[2] is not None:
            a, b = b, a  # a single one, if any, is b
        v, n = row(a)
        if b[2] is None:  # it joins the lightest entry
            node = b[3]
            if n[-1] >= 0:
                left.append(int(n[-1]))
                right.append(node)
                node = base + len(left) - 1
            w = v[-1] - b[0]
            at = int(np.searchsorted(-v[:-1], -w, side="right"))
            v, n = np.concatenate([v[:at], [w], v[at:-1]]), np.concatenate([n[:at], [node], n[at:-1]])
        else:
            nb = b[3][::-1]
            total = v + b[2][::-1]
            both = np.flatnonzero((n >= 0) & (nb >= 0))
            nodes = np.where(n >= 0, n, nb)
            left.extend(n[both].tolist())
            right.extend(nb[both].tolist())
            nodes[both] = base + len(left) - len(both) + np.arange(len(both))
            order = np.argsort(-total, kind="stable")
            v, n = total[order], nodes[order]
        v = v - v[-1]
        heapq.heappush(queue, (-float(v[0]), turn, v, n))
        turn += 1
    slot = np.full(base + len(left), -1, dtype=np.int64)
    if queue:
        _, last = row(queue[0])
        held = last >= 0
        slot[last[held]] = np.flatnonzero(held)
    for i in range(len(left) - 1, -1, -1):
        slot[left[i]] = slot[right[i]] = slot[base + i]
    return [slot[i * k : (i + 1) * k] for i in range(len(rows))], slot[k * len(rows) : base]


def deal_groups(weights: np.ndarray, bins: int) -> np.ndarray:
    """Slot of each of many weights."""
    return largest_differencing([], np.asarray(weights), bins)[1]


def balanced_bins(groups: DataFrame, group: str, weight: str, bins: int = BINS, per_task: int = PER_TASK) -> DataFrame:
    """(`group`, `bin`): `bins` bins of nearly equal weight. `groups` should be staged: it is read more than once.

    Hash buckets of about `per_task` groups are balanced by a task each; the bins of
    `FAN_IN` buckets are then combined by the same differencing, level by level, until
    one set of bins is left. Nothing but counts reaches the driver.
    """
    count = groups.count()
    buckets = max(1, math.ceil(count / per_task))
    kind = groups.schema[group].dataType.simpleString()

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([weight, group], ascending=[False, True], kind="stable")
        return pd.DataFrame({group: pdf[group], "bucket": pdf["bucket"], "slot": deal_groups(pdf[weight].to_numpy(), bins), "weight": pdf[weight]})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "slot"])
        names = pdf["bucket"].unique()
        rows = np.zeros((len(names), bins))
        at = np.searchsorted(names, pdf["bucket"])
        rows[at, pdf["slot"]] = pdf["weight"]
        slots = np.array(largest_differencing(list(rows), np.empty(0), bins)[0])
        return pd.DataFrame({"bucket": pdf["bucket"], "slot": pdf["slot"], "up": pdf["up"], "new": slots[at, pdf["slot"]], "weight": pdf["weight"]})

    hashed = groups.select(group, F.col(weight).cast("long").alias(weight), F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int").alias("bucket"))
    hashed = hashed.repartition(min(10_000, buckets), "bucket")  # few bytes, much work: left to itself the engine would put all buckets into one task
    dealt = stage(hashed.groupBy("bucket").applyInPandas(balance, f"`{group}` {kind}, bucket int, slot long, weight long"), "dealt")
    place = dealt.groupBy("bucket", "slot").agg(F.sum("weight").alias("weight")).withColumn("at", F.col("slot")).withColumn("home", F.col("bucket"))
    place = place.select("home", F.col("slot").alias("from_slot"), "bucket", F.col("at").alias("slot"), "weight")
    while buckets > 1:
        place = stage(place, "bins")
        sums = place.groupBy("bucket", "slot").agg(F.sum("weight").alias("weight"))
        up = sums.withColumn("up", F.floor(F.col("bucket") / FAN_IN).cast("int"))
        moved = up.groupBy("up").applyInPandas(combine, "bucket int, slot long, up int, new long, weight long").select("bucket", "slot", "up", "new")
        place = place.join(moved, ["bucket", "slot"]).select("home", "from_slot", F.col("up").alias("bucket"), F.col("new").alias("slot"), "weight")
        buckets = math.ceil(buckets / FAN_IN)
    final = place.select(F.col("home").alias("bucket"), F.col("from_slot").alias("slot"), F.col("slot").alias("bin"))
    return dealt.join(final, ["bucket", "slot"]).select(group, F.col("bin").cast("int").alias("bin"), "weight")


def allocate(weights: dict[int, int], shares: dict[str, float]) -> dict[int, str]:
    """Split of each bin: bins from the heaviest on go to the split that is furthest below its target.

    Bins of two splits are then exchanged while that brings both together nearer to
    their targets.
    """
    total = sum(weights.values())
    whole = sum(shares.values())
    lack = {name: total * share / whole for name, share in shares.items() if share > 0}
    out = {}
    for b in sorted(weights, key=lambda b: (-weights[b], b)):
        name = max(sorted(lack), key=lambda s: lack[s])
        out[b] = name
        lack[name] -= weights[b]
    better = True
    while better:
        better = False
        for a, b in itertools.combinations(sorted(lack), 2):
            one, two = ({weights[k]: k for k in sorted(out) if out[k] == s} for s in (a, b))
            now = abs(lack[a]) + abs(lack[b])
            gain, x, y = max(((now - abs(lack[a] + x - y) - abs(lack[b] - x + y), x, y) for x in one for y in two), default=(0, 0, 0))
            if gain > 1e-9:
                out[one[x]], out[two[y]] = b, a
                lack[a] += x - y
                lack[b] += y - x
                better = True
    return out


#: A list of columns, or several.
Links = Sequence[str] | Sequence[Sequence[str]]


def _links(together: Links) -> list[Sequence[str]]:
    return [together] if all(isinstance(c, str) for c in together) else list(together)


def _node(columns: Sequence[str], turn: int, alone: bool) -> Column:
    """The node of a link's values; if there are other links, null where all of them are null."""
    node = F.xxhash64(F.lit(turn), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns])
    return node if alone else F.when(F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(1)) for c in columns]).isNotNull(), node)


def related(df: DataFrame, record: str, together: Links) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Records that are bound together: those that agree in all columns of a link, or are bound to a common third.

    `together` is one link, a list of columns, or a list of links. The values of a link are the nodes of a graph, a record ties its nodes, and the
    connected components of the graph are the groups; with one link every node is a
    component. Returns the records (`__pl_r`, `node`), the nodes (`node`, `component`,
    `first`: the component's smallest record, `weight`: the node's records), the
    components (`component`, `weight`) and the number of records. Nodes are 64-bit
    hashes: of a billion values a pair coincides with a chance of 3 %, and binds what
    it needn't. A record without any link is a group of its own.
    """
    links = _links(together)
    nodes = [_node(link, i, len(links) == 1) for i, link in enumerate(links)]
    own = F.xxhash64(F.lit(-1), F.col(record))
    rows = df.select(F.col(record).alias("__pl_r"), F.coalesce(*nodes, own).alias("node"), *[n.alias(f"n{i}") for i, n in enumerate(nodes)])
    rows = stage(rows, "records")
    sized = stage(rows.groupBy("node").agg(F.min("__pl_r").alias("first"), F.count(F.lit(1)).alias("weight")), "nodes")
    if len(links) == 1:
        named = sized.withColumn("component", F.col("node"))
    else:
        ties = rows.select(F.col("node").alias("i"), F.explode(F.array(*[F.col(f"n{i}") for i in range(len(links))])).alias("j")).where("j is not null and i <> j").distinct()
        ties = stage(ties, "ties")
        every = sized.select("node").unionByName(ties.select(F.col("j").alias("node"))).distinct()
        named = stage(sized.join(components(ties, every), "node"), "bound")
    groups = stage(named.groupBy("component").agg(F.min("first").alias("first"), F.sum("weight").alias("weight")), "groups")
    keyed = named.drop("first").join(groups.select("component", "first"), "component")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    return rows.select("__pl_r", "node"), keyed, groups.select("component", "weight"), total


def related_records(df: DataFrame, record: str, together: Links) -> DataFrame:
    """(`record`, `first`): every record with the smallest of its group; the groups that `assign_splits` deals."""
    rows, keyed, _, total = related(df, record, together)
    return join_by_weight(rows, stage(keyed, "keyed"), ["node"], "weight", total).select(F.col("__pl_r").alias(record), "first")


def assign_splits(df: DataFrame, record: str, together: Links, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """(`record`, `first`, `split`): records that agree in all columns `together`, or in those of one of several links, directly or through others, get one split.

    `first` is the smallest record of the group. Groups are the components of
    `related`; a null value is a value of its own, but of several links one of nothing
    but nulls binds nothing. They are weighed, dealt into `bins` nearly equal bins, and whole bins are
    given to the splits of `shares` by what each lacks; a group larger than a bin has
    a bin of its own. The split of a record depends on the table only. Rows with equal
    or null records keep their number; no record means no `first`. Shares need not
    sum to 1; those of 0 or less get nothing. An empty table gives an empty table.
    """
    rows, keyed, groups, total = related(df, record, together)
    named = stage(balanced_bins(groups, "component", "weight", bins), "named")
    held = {r["bin"]: r["weight"] for r in named.groupBy("bin").agg(F.sum("weight").alias("weight")).collect()}  # at most `bins` rows
    of = allocate(held, shares)
    split = F.create_map(*[F.lit(x) for pair in of.items() for x in pair]) if of else F.create_map(F.lit(0), F.lit(""))
    dealt = keyed.join(named.select("component", split[F.col("bin")].alias("split")), "component")
    return join_by_weight(rows, stage(dealt, "keyed"), ["node"], "weight", total).select(F.col("__pl_r").alias(record), "first", "split")
