"""Runs of like consecutive events in ordered sequences (problem 4)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.staging import stage

#: Positions of a sequence per block: a block is one task's unit, whatever the sequence's length.
BLOCK = 4096
#: Blocks whose first and last runs are merged by one task; then blocks of such blocks, level by level.
LEVEL = 1024

_NO_TIME = -(1 << 62)


def agglomerate(alike: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Index of the run's first element for each element.

    Elements form a doubly linked list of one-element runs; `alike[i]` says whether
    element i may join the run before it and `distance[i]` how unlike they are at
    that border. A queue gives the most similar pair of neighbouring runs, which are
    merged, until no pair may. The pair's likeness is that of the two events at the
    border, which a merge elsewhere doesn't change, so the result doesn't depend on
    how a sequence is cut into blocks. Entries of runs merged meanwhile are skipped.
    """
    n = len(alike)
    head = np.arange(n)
    before = list(range(-1, n - 1))
    after = list(range(1, n + 1))
    last = list(range(n))
    alive = [True] * n
    borders = np.flatnonzero(alike)
    queue = [(d, i - 1, i) for d, i in zip(distance[borders].tolist(), borders.tolist(), strict=True)]
    heapq.heapify(queue)
    while queue:
        d, left, right = heapq.heappop(queue)
        if not alive[right]:
            continue
        if not alive[left] or after[left] != right:  # the left run has grown to the left since: its head is the neighbour now
            heapq.heappush(queue, (d, before[right], right))
            continue
        alive[right] = False
        last[left] = last[right]
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
    starts = np.flatnonzero(np.asarray(alive, dtype=bool))
    if n:
        head = np.repeat(starts, np.diff(np.append(starts, n)))
    return head


def agglomerate_runs(free: np.ndarray, sums: np.ndarray, n: np.ndarray, tolerance: float) -> np.ndarray:
    """Index of the run's first element for each element, runs being compared by their means.

    Elements are runs with `sums` (a column per number, NaN where there is none) over
    `n` events; `free[i]` says whether element i may stand in one run with the one
    before it. A queue gives the most similar pair of neighbouring runs, by the largest
    difference of a mean over max(1, |the left one's|); they are merged, the merged run's
    likeness to its neighbours is found anew, entries made before are skipped, and it
    ends when the most similar pair is further apart than `tolerance`.
    """
    count = len(n)
    total, size = sums.astype(float).copy(), n.astype(float).copy()
    before, after = list(range(-1, count - 1)), list(range(1, count + 1))
    alive, version = [True] * count, [0] * count

    def far(left: int, right: int) -> float:
        a, b = total[left] / size[left], total[right] / size[right]
        gap = np.abs(b - a) / np.maximum(1.0, np.abs(a))
        gap[(np.isnan(a) & np.isnan(b)) | (a == b)] = 0.0
        worst = float(gap.max()) if len(gap) else 0.0
        return np.inf if np.isnan(worst) else worst

    queue = [(d, i - 1, i, 0, 0) for i in np.flatnonzero(free).tolist() if i and (d := far(i - 1, i)) <= tolerance]
    heapq.heapify(queue)
    while queue:
        d, left, right, was, is_ = heapq.heappop(queue)
        if not (alive[left] and alive[right]) or version[left] != was or version[right] != is_:
            continue
        total[left] += total[right]
        size[left] += size[right]
        alive[right] = False
        version[left] += 1
        after[left] = after[right]
        if after[left] < count:
            before[after[left]] = left
        for a, b in ((before[left], left), (left, after[left])):
            if a >= 0 and b < count and free[b] and (d := far(a, b)) <= tolerance:
                heapq.heappush(queue, (d, a, b, version[a], version[b]))
    starts = np.flatnonzero(np.asarray(alive, dtype=bool))
    return np.repeat(starts, np.diff(np.append(starts, count))) if count else np.arange(0)


def _border(first: np.ndarray, second: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether numbers agree with the ones before them, and their relative distance; NaN stands for no number."""
    none = np.isnan(first) & np.isnan(second)
    with np.errstate(invalid="ignore"):
        gap = np.abs(second - first)
        size = np.maximum(1.0, np.abs(first))
        near = (first == second) | (np.isfinite(gap) & np.isfinite(size) & (gap <= tolerance * size))
        return none | near, np.where(none | (first == second) | ~np.isfinite(gap), 0.0, gap / size)


_EDGE = "first_pos bigint, last_pos bigint, n bigint, t_min bigint, t_max bigint"


def _number(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _runs(keys: pa.Array, rows: pa.Array, block: pa.Array, numbers: int, flags: int, tolerance: float, max_gap: int | None, by_run: bool) -> dict:
    """Runs of a batch of blocks of events, or of groups of blocks given by their edge runs."""
    lengths = rows.value_lengths().to_numpy(zero_copy_only=False)
    flat = rows.flatten()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    column = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
    n = len(owner)
    whole = {c: column[c].to_numpy(zero_copy_only=False) for c in ("first_pos", "last_pos", "n", "t_min", "t_max")}
    alike = np.zeros(n, dtype=bool)
    distance = np.zeros(n)
    if n > 1:
        same = owner[1:] == owner[:-1]
        if "block" in column:
            parts = column["block"].to_numpy(zero_copy_only=False)
            same &= parts[1:] != parts[:-1]
        for i in range(flags):
            same &= _number(column[f"fv{i}"])[1:] == _number(column[f"lv{i}"])[:-1]
        far = np.zeros(n - 1)
        for i in range(0 if by_run else numbers):
            near, gap = _border(_number(column[f"ln{i}"])[:-1], _number(column[f"fn{i}"])[1:], tolerance)
            same &= near
            far += gap
        if max_gap is not None:
            begin, end = whole["t_min"][1:], whole["t_max"][:-1]
            same &= (begin == _NO_TIME) | (end == _NO_TIME) | (begin - end <= max_gap)
        alike[1:], distance[1:] = same, far
    if by_run:
        held = [_number(column[f"s{i}"]) for i in range(numbers)]
        sums = np.column_stack(held) if held else np.zeros((n, 0))
        head = agglomerate_runs(alike, sums, whole["n"], tolerance)
    else:
        head = agglomerate(alike, distance)
    first = np.flatnonzero(head == np.arange(n))
    last = np.append(first[1:], n)[: len(first)] - 1
    out = {
        "keys": keys.take(pa.array(owner[first])),
        "owner": owner[first],
        "first_pos": whole["first_pos"][first],
        "last_pos": whole["last_pos"][last],
        "n": np.add.reduceat(whole["n"], first) if n else whole["n"],
    }
    known_min = np.where(whole["t_min"] == _NO_TIME, -_NO_TIME, whole["t_min"])
    out["t_min"] = np.minimum.reduceat(known_min, first) if n else known_min
    out["t_max"] = np.maximum.reduceat(whole["t_max"], first) if n else whole["t_max"]
    out["t_min"] = np.where(out["t_min"] == -_NO_TIME, _NO_TIME, out["t_min"])
    for i in range(flags):
        out[f"fv{i}"], out[f"lv{i}"] = column[f"fv{i}"].take(pa.array(first)), column[f"lv{i}"].take(pa.array(last))
    for i in range(numbers):
        out[f"fn{i}"], out[f"ln{i}"] = column[f"fn{i}"].take(pa.array(first)), column[f"ln{i}"].take(pa.array(last))
        if by_run:
            out[f"s{i}"] = np.add.reduceat(_number(column[f"s{i}"]), first) if n else np.empty(0)
    out["block"] = block.take(pa.array(owner[first]))
    count = np.bincount(owner[first], minlength=len(lengths))
    ends = np.cumsum(count)
    edge = np.zeros(len(first), dtype=bool)
    edge[ends[count > 0] - 1] = True
    edge[(ends - count)[count > 0]] = True
    out["edge"] = edge
    return out


def collapse_runs(
    df: DataFrame,
    entity: str,
    position: str,
    numbers: Sequence[str] = (),
    flags: Sequence[str | Column] = (),
    time: str | None = None,
    latest_by: str | None = None,
    tolerance: float = 1e-6,
    max_gap_s: float | None = None,
    block: int = BLOCK,
    at_least: int = 1,
    likeness: str = "event",
    level: int = LEVEL,
) -> DataFrame:
    """One row per longest stretch of events of an entity in which each agrees with the one before it.

    Columns: `entity`, `first_pos`, `last_pos`, `n` (events), `duration_s` (from the
    earliest to the latest `time` of the stretch, null without any). Two events agree
    if all `flags` are equal (null equals null) and each of `numbers` is missing in
    both (null or NaN) or differs by at most tolerance * max(1, |the earlier|), and,
    with `max_gap_s`, if their times are not further apart. Missing positions between
    events don't matter. Events delivered more than once at a position count once:
    the latest by `latest_by`. Events without entity or position are left out.
    Stretches shorter than `at_least` are dropped at the end. Empty tables give none.

    With `likeness` "run" neighbouring runs are compared as wholes: the most similar two
    are merged, again and again, while flags agree, numbers are missing in both or in
    neither, the gap allows, and their means differ by at most tolerance * max(1, |the
    earlier's|); so a slow drift ends a run, which it doesn't among events.

    A sequence is cut into blocks of `block` positions, so that no task holds a whole
    one; runs within a block are merged, then the first and last runs of `level` blocks
    among themselves, then those of `level` such groups, until one is left. Among events
    the cuts can't change the result; among runs, one that touches no cut is final.
    """
    if likeness not in ("event", "run"):
        raise ValueError(likeness)
    by_run = likeness == "run"
    marks = [f if isinstance(f, Column) else F.col(f) for f in flags]
    at = F.lit(0) if latest_by is None else F.coalesce(F.unix_micros(F.col(latest_by).cast("timestamp")), F.lit(_NO_TIME))
    moment = F.lit(_NO_TIME) if time is None else F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(_NO_TIME))
    plain = df.where(F.col(entity).isNotNull() & F.col(position).isNotNull()).select(
        F.col(entity).alias("__pl_e"),
        F.col(position).cast("int").alias("__pl_p"),
        at.cast("long").alias("__pl_at"),
        moment.cast("long").alias("__pl_t"),
        *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(numbers)],
        *[F.coalesce(m.cast("int"), F.lit(-1)).alias(f"v{i}") for i, m in enumerate(marks)],
    )
    names = [c for c in plain.columns if c not in ("__pl_e", "__pl_p", "__pl_at")]
    once = plain.groupBy("__pl_e", "__pl_p").agg(*[F.max_by(c, "__pl_at").alias(c) for c in names])
    event = F.struct(
        F.col("__pl_p").cast("long").alias("first_pos"),
        F.col("__pl_p").cast("long").alias("last_pos"),
        F.lit(1).cast("long").alias("n"),
        F.col("__pl_t").alias("t_min"),
        F.col("__pl_t").alias("t_max"),
        *[F.col(f"n{i}").alias(f"{s}n{i}") for i in range(len(numbers)) for s in "fl"],
        *[F.col(f"v{i}").alias(f"{s}v{i}") for i in range(len(marks)) for s in "fl"],
        *[F.col(f"n{i}").alias(f"s{i}") for i in range(len(numbers)) if by_run],
    )
    kind = df.schema[entity].dataType.simpleString()
    run = _EDGE + "".join(f", {s}n{i} double" for i in range(len(numbers)) for s in "fl") + "".join(f", {s}v{i} int" for i in range(len(marks)) for s in "fl")
    run += "".join(f", s{i} double" for i in range(len(numbers)) if by_run)
    fields = [f.split(" ")[0] for f in run.split(", ")]
    gap = None if max_gap_s is None else round(max_gap_s * 1e6)
    n_numbers, n_flags = len(numbers), len(marks)

    names_out = ["entity", "block", "edge", *fields]
    schema = f"entity {kind}, block int, edge boolean, {run}"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _runs(batch.column(0), batch.column(1), batch.column(2), n_numbers, n_flags, tolerance, gap, by_run)
            mask = pa.array(found["edge"] | (found["n"] >= at_least))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in (found["keys" if c == "entity" else c] for c in names_out)]
            yield pa.RecordBatch.from_arrays([a.filter(mask) for a in arrays], names=names_out)

    blocks = (
        once.withColumn("block", F.floor(F.col("__pl_p") / block).cast("int"))
        .groupBy("__pl_e", "block")
        .agg(F.sort_array(F.collect_list(event)).alias("events"))
        .select("__pl_e", "events", "block")
    )
    held = stage(blocks.mapInArrow(merge, schema), "runs")
    ends = held.agg(F.min("block"), F.max("block")).first()
    lowest, span = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0) + 1
    short = ["entity", "first_pos", "last_pos", "n", "t_min", "t_max"]
    done = None
    while True:
        inner = held.where((~F.col("edge") if span > 1 else F.lit(True)) & (F.col("n") >= at_least)).select(*short)
        done = inner if done is None else done.unionByName(inner)
        if span <= 1:
            break
        up = F.floor((F.col("block") - lowest) / level).cast("int")
        edges = held.where("edge").groupBy("entity", up.alias("up")).agg(F.sort_array(F.collect_list(F.struct(*fields, "block"))).alias("events")).select("entity", "events", "up")
        lowest, span = 0, -(-span // level)
        held = edges.mapInArrow(merge, schema)
        if span > 1:
            held = stage(held, "runs")
    known = F.col("t_min") != _NO_TIME
    return done.select(
        F.col("entity").alias(entity),
        F.col("first_pos").cast("int").alias("first_pos"),
        F.col("last_pos").cast("int").alias("last_pos"),
        "n",
        F.when(known, (F.col("t_max") - F.col("t_min")) / F.lit(1e6)).alias("duration_s"),
    )
