"""Byte-level byte pair encoding of a corpus with the ranks of a public vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of at most so many bytes are merged on a rank array; a scan of it is linear in the word.
SHORT = 256
#: Words whose ids a worker remembers; at the bound it forgets all.
REMEMBERED = 200_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its id."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word on a contiguous array of part boundaries and of the ranks of adjacent parts.

    Again and again the lowest rank is found by a scan, the boundary between its two parts is deleted, and the ranks
    of the pairs to its left and right are refreshed.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    none = len(ranks) + 1
    bounds = list(range(len(word) + 1))
    pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        del bounds[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(word[bounds[i] : bounds[i + 2]], none)
        if i:
            pairs[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length: linked parts and a heap of pairs, so the work stays near linear."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # 0: the part is gone
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (r := ranks.get(word[i : end[j]])) is not None:
            heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heappop(heap)
        if not end[i] or (j := after[i]) >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], after[i], end[j] = stop, after[j], 0
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = after[i]
    return ids


class WordIds(dict):
    """Ids by word, made when first asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        if len(data) > SHORT:
            return merge_long(data, self.ranks)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = merge_short(data, self.ranks)
        return ids


def encode_corpus(df: DataFrame, *, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """``(id, ids)``: each text's token ids as a list of integers, one row for every row.

    ``ranks_path`` is a vocabulary file on the driver (lines of base64 token and id, at most some 100,000: its bytes
    are broadcast, about 1 MB); ``pattern`` splits a text into words. There are no special tokens: their strings are
    ordinary text. An empty or null text has the empty list. Repeated rows come out repeatedly; other columns are
    never read. A narrow map: no shuffle, and words are remembered per worker.
    """
    with open(ranks_path, "rb") as file:
        data = df.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import regex

        words, cache = regex.compile(pattern).findall, WordIds(parse_ranks(data.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # long texts: few rows at a time
                part = batch.slice(start, 512)
                flat, offsets = [], [0]
                for text in part.column(1).to_pylist():
                    if text:
                        flat.extend(chain.from_iterable(map(cache.__getitem__, words(text))))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")
