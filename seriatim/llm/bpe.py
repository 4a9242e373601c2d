"""Byte-level BPE encoding of a corpus with a public vocabulary, by contiguous rank arrays.

A text is cut into words by the vocabulary's pattern. A word that is no token is merged by
holding its part boundaries and the rank of each pair of adjacent parts in two contiguous
arrays: scan for the smallest rank, delete the boundary between the two parts, refresh the
ranks on either side, repeat. The scan is quadratic in the word's length, so words beyond
SHORT bytes keep the same ranks in a heap over linked boundaries instead; both give the same
ids. Workers keep the ids of the words they have met, up to a fixed number of words.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.sources.tables import require

VOCABULARY = "byte_bpe_50k"
#: Folder of the vocabulary files; a parameter of every operator here.
FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 96
KEPT_WORDS = 400_000
ABSENT = 1 << 60


@lru_cache(4)
def ranks(folder: str = FOLDER, name: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id, from the vocabulary's rank file."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a word by repeated minimum scans over contiguous boundaries and ranks."""
    n = len(word)
    bounds = list(range(n + 1))
    pair = [rank.get(word[i : i + 2], ABSENT) for i in range(n - 1)]
    while pair:
        low = min(pair)
        if low == ABSENT:
            break
        k = pair.index(low)
        del bounds[k + 1], pair[k]
        if k < len(pair):
            pair[k] = rank.get(word[bounds[k] : bounds[k + 2]], ABSENT)
        if k:
            pair[k - 1] = rank.get(word[bounds[k - 1] : bounds[k + 1]], ABSENT)
    return [rank[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: a heap of (rank, position) over linked boundaries."""
    n = len(word)
    after, before, end = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = 0, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := rank.get(word[p : end[i]])) is not None:
            heapq.heappush(heap, (r, p, end[i]))
    return [rank[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts with one vocabulary and remembers words."""

    def __init__(self, folder: str = FOLDER, name: str = VOCABULARY):
        self.rank = ranks(folder, name)
        self.words: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PATTERN).findall

    def word(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.rank.get(raw)
        ids = (whole,) if whole is not None else tuple((merge_short if len(raw) <= SHORT else merge_long)(raw, self.rank))
        if len(self.words) < KEPT_WORDS and len(raw) <= SHORT:
            self.words[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of an empty or null text an empty list."""
        out: list[int] = []
        known, add = self.words.get, out.extend
        for w in self.find(text) if text else ():
            add(known(w) or self.word(w))
        return out


@lru_cache(4)
def encoder(folder: str = FOLDER, name: str = VOCABULARY) -> Encoder:
    """This worker's encoder of a vocabulary."""
    return Encoder(folder, name)


def _encoded(folder: str, name: str, count_only: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            flat, ends = array("i"), [0]
            for text in b.column(1):
                ids = enc.encode(text.as_py())
                if not count_only:
                    flat.extend(ids)
                ends.append(len(ids) if count_only else ends[-1] + len(ids))
            if count_only:
                got, field = pa.array(ends[1:], pa.int64()), "n_tokens"
            else:
                got, field = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32())), "ids"
            yield pa.RecordBatch.from_arrays([b.column(0), got], [b.schema.names[0], field])

    return of


def encoded(df: DataFrame, id_column: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """The token ids of every text: id, ids (array<int>), without special tokens.

    The strings of special tokens inside a text are ordinary text. Empty and null texts give an
    empty list; repeated rows and ids stay as they are; very long texts and words are encoded
    whole; a null id is kept. Columns other than the two are ignored.
    """
    require(df, [id_column, text])
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(_encoded(folder, name, False), f"`{id_column}` {kind}, ids array<int>")


def lengths(df: DataFrame, id_column: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """The number of tokens of every text: id, n_tokens; null and empty texts have none."""
    require(df, [id_column, text])
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(_encoded(folder, name, True), f"`{id_column}` {kind}, n_tokens bigint")
