"""Percentiles with bounded error from summaries that can be combined (problem 3).

A summary of n numbers is a row of buffers. That of a level h > 0 holds exactly
`BUFFER` sorted values that stand for 2**h numbers each; level 0 holds fewer than
twice `BUFFER` numbers as they are. Two buffers of a level are merged and collapsed to one
of the next by taking every second position, the first or the second in turn; so the
levels behave as a binary counter and a tree of merges gives the same structure in
any order. A collapse at level h moves a rank by at most 2**h, so the error of all is
at most n * log2(n / BUFFER) / (2 * BUFFER) ranks: below 1 % of n for n up to
BUFFER * 2**40. Nothing is random. The bound reached is kept with each summary.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.staging import stage

BUFFER = 2048
#: So many summaries of a key are merged in one go at most; beyond, in rounds.
FAN_IN = 64
#: Numbers held by a task before their summaries are written out.
HELD = 2_000_000

SUMMARY = "n bigint, rank_error bigint, sizes array<int>, body binary"


class Summary:
    """The buffers of one key."""

    def __init__(self, buffer: int = BUFFER):
        self.buffer, self.n, self.rank_error = buffer, 0, 0
        self.levels: list[list[np.ndarray]] = [[]]
        self.turns: list[int] = [0]

    def add(self, values: np.ndarray) -> None:
        """Add numbers (no NaN)."""
        self.n += len(values)
        self.levels[0].append(values)

    def join(self, n: int, rank_error: int, sizes: Sequence[int], body: bytes) -> None:
        """Add a summary as written by `packed`."""
        self.n += n
        self.rank_error += rank_error
        values, at = np.frombuffer(body, dtype="<f8"), 0
        for level, size in enumerate(sizes):
            self._reach(level)
            if size:
                self.levels[level].append(values[at : at + size])
                at += size

    def _reach(self, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
            self.turns.append(0)

    def settle(self) -> None:
        """Collapse until no level above 0 has more than one buffer and level 0 less than two."""
        loose = np.concatenate(self.levels[0]) if self.levels[0] else np.empty(0)
        whole = len(loose) // self.buffer * self.buffer
        full = list(np.sort(loose[:whole].reshape(-1, self.buffer), axis=1))
        self.levels[0] = [np.sort(loose[whole:])]
        level = 0
        while True:
            if level:
                full += self.levels[level]
                self.levels[level] = full[: len(full) % 2]
                full = full[len(full) % 2 :]
            elif len(full) % 2:  # an odd full buffer stays among the loose numbers
                self.levels[0] = [np.concatenate([*self.levels[0], full.pop()])]
            if not full:
                if level + 1 >= len(self.levels):
                    return
                level += 1
                continue
            self._reach(level + 1)
            up = []
            for a, b in zip(full[::2], full[1::2], strict=True):
                both = np.sort(np.concatenate([a, b]), kind="stable")
                up.append(both[self.turns[level] :: 2])
                self.turns[level] ^= 1
                self.rank_error += 1 << level
            full = up
            level += 1

    def packed(self) -> tuple[int, int, list[int], bytes]:
        """(n, rank error, size of each level, values of all levels)."""
        self.settle()
        parts = [np.concatenate(x) if x else np.empty(0) for x in self.levels]
        return self.n, self.rank_error, [len(p) for p in parts], np.concatenate(parts).astype("<f8").tobytes()


def quantiles(n: int, sizes: Sequence[int], body: bytes, permille: Sequence[int]) -> list[float | None]:
    """The values at ranks ceil(n * q / 1000) by the summary's weights; exact while nothing was collapsed."""
    if not n:
        return [None] * len(permille)
    values = np.frombuffer(body, dtype="<f8")
    weights = np.repeat([1 << level for level in range(len(sizes))], sizes)
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    ranks = [max(1, -(-n * q // 1000)) for q in permille]
    return [float(values[order[min(int(np.searchsorted(upto, r)), len(order) - 1)]]) for r in ranks]


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _partial(df: DataFrame, keys: Sequence[str], measures: Sequence[str], buffer: int, most: int = HELD) -> DataFrame:
    """Summaries of what each task has of each key and measure, `most` numbers at a time, each with a number of its own."""
    keys, measures = list(keys), list(measures)
    out = f"{_key_fields(df, keys)}, measure string, {SUMMARY}"

    def flush(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = pd.concat(frames, ignore_index=True)
        at = data.groupby(keys, dropna=False, sort=False)
        code = at.ngroup().to_numpy()
        first = data[keys].iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
        rows = []
        for m in measures:
            x = data[m].to_numpy(dtype="float64", na_value=np.nan)
            ok = ~np.isnan(x)
            x, g = x[ok], code[ok]
            order = np.argsort(g, kind="stable")
            x, g = x[order], g[order]
            ids, starts = np.unique(g, return_index=True)
            for i, values in zip(ids, np.split(x, starts[1:]), strict=True) if len(ids) else ():
                s = Summary(buffer)
                s.add(values)
                rows.append((int(i), m, *s.packed()))
        if rows:
            made = pd.DataFrame(rows, columns=["__i", "measure", "n", "rank_error", "sizes", "body"])
            yield pd.concat([first.iloc[made["__i"]].reset_index(drop=True), made.drop(columns="__i")], axis=1)

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        turn = 0
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= most:
                yield from (made.assign(__pl_turn=turn) for made in flush(held))
                held, turn = [], turn + 1
        if sum(map(len, held)):
            yield from (made.assign(__pl_turn=turn) for made in flush(held))

    made = df.select(*keys, *measures).mapInPandas(summarise, f"{out}, __pl_turn int")
    return made.withColumn("__pl_part", F.xxhash64(F.spark_partition_id(), "__pl_turn")).drop("__pl_turn")


def _merged(df: DataFrame, keys: Sequence[str], buffer: int) -> DataFrame:
    """One summary per key from the summaries of `df`."""
    keys = list(keys)
    packed = df.groupBy(*keys).agg(F.collect_list(F.struct("n", "rank_error", "sizes", "body")).alias("__pl_parts"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for parts in frame["__pl_parts"]:
                s = Summary(buffer)
                for p in sorted(parts, key=lambda p: (p["n"], bytes(p["body"]))):  # any order of arrival gives one result
                    s.join(p["n"], p["rank_error"], p["sizes"], p["body"])
                rows.append(s.packed())
            if rows:
                yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["n", "rank_error", "sizes", "body"])], axis=1)

    return packed.mapInPandas(merge, f"{_key_fields(df, keys)}, {SUMMARY}")


def _tree(parts: DataFrame, by: Sequence[str], buffer: int) -> DataFrame:
    """One summary per key of `parts`, whose `__pl_part` tells the summaries of a key apart.

    The summaries that a key has are counted, not guessed from settings; while a key has
    more than `FAN_IN`, they are merged by buckets of about half as many.
    """
    while True:
        parts = stage(parts, "summaries")
        most = parts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if most <= FAN_IN:
            return _merged(parts, by, buffer)
        bucket = F.pmod(F.xxhash64("__pl_part"), F.lit(math.ceil(2 * most / FAN_IN)))
        parts = _merged(parts.withColumn("__pl_part", bucket), [*by, "__pl_part"], buffer)


def summarise(df: DataFrame, keys: Sequence[str], measures: Sequence[str], buffer: int = BUFFER, held: int = HELD) -> DataFrame:
    """A mergeable summary of each of `measures` for every value of `keys`.

    Each task summarises what it has of a key, so a key with many rows is small
    before it is shuffled; the parts of a key are merged in a tree of fan-in
    `FAN_IN`. Nulls and NaN are left out, infinities are numbers; a key without
    numbers has no row; null is a key of its own. Columns: keys, `measure`, `n`,
    `rank_error` (bound reached, in ranks), `sizes`, `body`.
    """
    return _tree(_partial(df, keys, measures, buffer, held), [*keys, "measure"], buffer)


def combine(summaries: DataFrame, keys: Sequence[str], buffer: int = BUFFER) -> DataFrame:
    """Summaries of longer periods or coarser keys: those of `summaries` that agree in `keys` and `measure` become one, in a tree of fan-in `FAN_IN`."""
    rest = [c for c in summaries.columns if c not in (*keys, "measure", "sizes")]
    return _tree(summaries.withColumn("__pl_part", F.xxhash64(*rest)), [*keys, "measure"], buffer)


def percentiles(summaries: DataFrame, permille: Sequence[int] = (500, 900, 950, 990)) -> DataFrame:
    """Add a column per asked percentile (`p50`, `p99`, `p99_9` ...) to summaries and drop the buffers."""
    kept = [c for c in summaries.columns if c not in ("sizes", "body")]
    names = [f"p{q / 10:g}".replace(".", "_") for q in permille]
    out = ", ".join(f"`{c}` {summaries.schema[c].dataType.simpleString()}" for c in kept) + "".join(f", {n} double" for n in names)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: Iterable = [quantiles(n, s, b, permille) for n, s, b in zip(frame["n"], frame["sizes"], frame["body"], strict=True)]
            yield pd.concat([frame[kept].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype="float64")], axis=1)

    return summaries.mapInPandas(read, out)
