"""Held-out test passages within a corpus (problem 7)."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pointloom.llm.texts import word_spans, words
from pointloom.operators.staging import stage

#: Words that a passage must have in common with an item.
WORDS = 10
#: Bytes of a broadcast index as measured; more items are searched in as many passes as needed.
MAX_INDEX_BYTES = 256_000_000
#: Bytes of an index for each of item text, to begin with; a block that measures more is halved.
BYTES_A_BYTE = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of `n` word ids."""
    total = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * _BASE + ids[k : len(ids) - n + 1 + k].astype(np.uint64) + np.uint64(1)
    return total


class Index:
    """The n-grams of a set of items in a few arrays: hashes to look up, and the items' words to verify by.

    `text` holds the word numbers of all items one after another, `starts` where each
    begins; `hashes` are those of all windows, sorted, and `places` where each window begins.
    """

    def __init__(self, items: list[tuple[object, str | None]], n: int = WORDS):
        self.n = n
        self.word: dict[str, int] = {}
        self.names = [item for item, _ in items]
        each = [np.array([self.word.setdefault(w, len(self.word)) for w in words(text or "")], dtype=np.int32) for _, text in items]
        self.starts = np.cumsum([0, *[len(ids) for ids in each]], dtype=np.int64)[:-1]
        self.text = np.concatenate([np.empty(0, dtype=np.int32), *each])
        hashes = np.concatenate([np.empty(0, dtype=np.uint64), *[_windows(ids, n) for ids in each]])
        places = np.concatenate([np.empty(0, dtype=np.int64), *[at + np.arange(max(0, len(ids) - n + 1)) for at, ids in zip(self.starts, each, strict=True)]])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]

    @property
    def size(self) -> int:
        """Bytes in memory: the arrays, and the words with their numbers."""
        held = self.text.nbytes + self.starts.nbytes + self.hashes.nbytes + self.places.nbytes
        return held + sys.getsizeof(self.word) + sum(sys.getsizeof(w) + 32 for w in self.word) + 48 * len(self.names)

    def hits(self, tokens: list[str]) -> list[tuple[int, list[object]]]:
        """(first word, items) of each window that is an n-gram of items.

        Words unknown to the items break the text into stretches; only windows within
        stretches are hashed, looked up and then compared word by word.
        """
        n = self.n
        if len(tokens) < n or not len(self.hashes):
            return []
        get = self.word.get
        ids = np.array([get(t, -1) for t in tokens], dtype=np.int32)
        unknown = np.flatnonzero(ids < 0)
        bounds = np.concatenate([[-1], unknown, [len(ids)]])
        out = []
        for k in np.flatnonzero(np.diff(bounds) > n):
            start, stretch = int(bounds[k]) + 1, ids[bounds[k] + 1 : bounds[k + 1]]
            h = _windows(stretch, n)
            low, high = np.searchsorted(self.hashes, h, side="left"), np.searchsorted(self.hashes, h, side="right")
            for i in np.flatnonzero(high > low).tolist():
                places = self.places[low[i] : high[i]]
                same = places[(self.text[places[:, None] + np.arange(n)] == stretch[i : i + n]).all(axis=1)]
                if len(same):
                    held = (np.searchsorted(self.starts, same, side="right") - 1).tolist()
                    out.append((start + i, [self.names[j] for j in (sorted(set(held)) if len(held) > 1 else held)]))
        return out


def _indexes(items: DataFrame, item: str, text: str, n: int, max_bytes: int) -> Iterator[Index]:
    """Indexes of all items, each of `max_bytes` at most as measured, unless a single item is larger."""
    size, count = items.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    blocks = max(1, min(count, math.ceil((size or 0) * BYTES_A_BYTE / max_bytes)))
    plain = items.select(item, text)
    for b in range(blocks):
        part = plain if blocks == 1 else plain.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b)
        waiting = [[(r[0], r[1]) for r in part.collect()]]  # so many bytes of text as the block was made for
        while waiting:
            now = waiting.pop()
            if blocks > 1 and not now:
                continue
            index = Index(now, n)
            if index.size <= max_bytes or len(now) < 2:
                yield index
            else:
                waiting += [now[: len(now) // 2], now[len(now) // 2 :]]


def find_leaks(
    docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = WORDS, max_bytes: int = MAX_INDEX_BYTES
) -> DataFrame:
    """(`doc`, `item`, `n_windows`, `first_word`, `last_word`): documents and items with `n` or more consecutive words in common.

    `n_windows` is the number of places at which `n` words agree, the others the
    range of words they lie in. Words are runs of letters and digits; case, markup,
    unseen characters and compatibility forms make no difference. Texts are scanned
    whole. Null and short texts have no hits; an item that repeats another's words is
    reported beside it; repeated document ids are reported row by row. Items whose
    index would exceed `max_bytes` are searched in several passes over the corpus.
    """
    spark = docs.sparkSession
    kinds = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}"
    item_type = to_arrow_type(items.schema[item].dataType)
    found = None
    for held in _indexes(items, item, item_text, n, max_bytes):
        index = spark.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            look = index.value
            for batch in batches:
                at, rows = [], []
                for i, raw in enumerate(batch.column(1)):
                    if (b := raw.as_py()) is None:
                        continue
                    seen: dict[object, list[int]] = {}
                    for first, named in look.hits(words(b.decode("utf-8", errors="replace"))):
                        for x in named:
                            place = seen.setdefault(x, [0, first, first])
                            place[0] += 1
                            place[2] = first
                    for x, (count, first, last) in seen.items():
                        at.append(i)
                        rows.append((x, count, first, last + look.n - 1))
                columns = [pa.array([r[k] for r in rows], type=item_type if k == 0 else pa.int32()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int64())), *columns], names=[doc, item, "n_windows", "first_word", "last_word"])

        one = docs.select(F.col(doc), F.col(text).cast("binary").alias("__pl_text")).where("__pl_text is not null").mapInArrow(scan, f"{kinds}, n_windows int, first_word int, last_word int")
        found = one if found is None else found.unionByName(one)
    return found


def _merged(ranges: Iterator[tuple[int, int]]) -> list[list[int]]:
    """Ranges of words as few as possible: those that overlap or touch are one."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _without(text: str, ranges: list[list[int]]) -> str:
    """`text` without ranges of its words; where words have no exact place, the words that remain."""
    spans = word_spans(text)
    if spans:
        for first, last in reversed(ranges):
            text = text[: spans[first][1]] + text[spans[last][2] :]
        return text
    gone = {i for first, last in ranges for i in range(first, last + 1)}
    return " ".join(w for i, w in enumerate(words(text)) if i not in gone)


def remove_leaks(
    docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = WORDS, max_bytes: int = MAX_INDEX_BYTES
) -> DataFrame:
    """(`doc`, `text`, `n_removed`): every document with the passages it shares with items cut out.

    Ranges of agreeing words are found in the text as it is, by as many passes as the
    items need, merged, and cut once, from the first to the last of their characters;
    so the result doesn't depend on the number of passes. Of a text whose words can't
    be placed exactly the remaining words are kept, parted by blanks. Texts without
    hits, null ones included, stay as they are.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc].dataType.simpleString()
    found = "array<struct<first: int, last: int>>"
    ranges_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    out = docs.select(F.col(doc), F.col(text).cast("binary").alias("text"), F.array().cast(found).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for raw, held in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                b = raw.as_py()
                t = None if b is None else b.decode("utf-8", errors="replace")
                ranges = _merged((r["first"], r["last"]) for r in held)
                texts.append(_without(t, ranges) if ranges else t)
                counts.append(len(ranges))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string()), pa.array(counts, type=pa.int32())], names=[doc, "text", "n_removed"])

    for turn, held in enumerate(_indexes(items, item, item_text, n, max_bytes)):
        index = spark.sparkContext.broadcast(held)

        def mark(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            look = index.value
            for batch in batches:
                marks = []
                for raw, before in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                    b = raw.as_py()
                    hits = look.hits(words(b.decode("utf-8", errors="replace"))) if b else []
                    ranges = _merged([(r["first"], r["last"]) for r in before] + [(first, first + look.n - 1) for first, _ in hits])
                    marks.append([{"first": first, "last": last} for first, last in ranges])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, type=ranges_type)], names=[doc, "text", "ranges"])

        if turn:  # a task holds one index at a time
            out = stage(out, "marked")
        out = out.mapInArrow(mark, f"`{doc}` {kind}, text binary, ranges {found}")
    return out.mapInArrow(cut, f"`{doc}` {kind}, text string, n_removed int")
