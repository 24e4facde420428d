"""Encoding of texts by a byte-level vocabulary of merges (problem 6)."""

from __future__ import annotations

import array
import base64
import heapq
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text into pieces before merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary is sent to every worker: larger ones are refused.
MAX_VOCABULARY = 1_000_000
#: Pieces whose ids a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ids by byte string of a file with a base64 string and an id per line; the id is the merge's rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} entries")
    return ranks


class Encoder(dict):
    """Ids of pieces of text, remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.ranks, self.cut = ranks, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> list[int]:
        ids = self.merged(piece.encode("utf-8"))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece after all merges.

        Symbols form a doubly linked list by the byte they start at, bytes at first.
        A queue gives the neighbours whose merge has the lowest rank, the leftmost of
        equal ones; an entry is stale, and skipped, if its symbols have meanwhile been
        merged with others, that is, if they no longer span the bytes it was made for.
        """
        ranks, n = self.ranks, len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = bytearray(b"\x01" * n)
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            if not alive[i] or (mid := after[i]) >= n or after[mid] != end:
                continue
            alive[mid] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(queue, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(queue, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> Iterator[int]:
        """Ids of a text."""
        return chain.from_iterable(map(self.__getitem__, self.cut(text)))


def decode(ids: list[int], strings: dict[int, bytes]) -> str:
    """The text of ids: their byte strings one after the other; ids that are not in the vocabulary are an error."""
    return b"".join(strings[i] for i in ids).decode("utf-8", errors="replace")


_encoders: dict[tuple, Encoder] = {}


def _encoder(key: tuple, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(`key`, `ids`): the ids of each row's text, without special tokens, whose strings are ordinary text.

    One row per row of `df`, whatever its key. Null and empty texts have an empty
    list. A text is encoded whole, however long; bytes that are not UTF-8 count as
    U+FFFD. The vocabulary is read on the driver and is bounded by `MAX_VOCABULARY`.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = df.schema[key].dataType.simpleString()
    name = (vocabulary, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(name, ranks.value, pattern)
        for batch in batches:
            flat, ends = array.array("i"), [0]
            for raw in batch.column(1):
                if (b := raw.as_py()) is not None:
                    flat.extend(e.encode(b.decode("utf-8", errors="replace")))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).cast("binary").alias("__pl_text")).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(`key`, `text`): the text of each row's ids; an empty text for an empty list, null for null."""
    ranks = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = {i: b for b, i in ranks.value.items()}
        for batch in batches:
            texts = [None if x is None else decode(x, strings) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids).alias("__pl_ids")).mapInArrow(read, f"`{key}` {kind}, text string")
