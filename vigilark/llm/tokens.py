"""Byte-level BPE of whole corpora.

Merging uses a rank queue: one bucket per merge rank holds the places in a linked list of symbols where that
merge applies; a two-level bitmap over the ranks finds the next bucket with two find-first-set steps. Entries that a
neighbouring merge has made stale are skipped when they come up. A pre-token of n bytes takes O(n) queue steps, so very long
pre-tokens (unbroken sequences, text without spaces) cost no more per byte than short ones.

Around the queue stand two caches per task, of pre-tokens and of space-delimited pieces, both emptied when full: they
change the speed, never the ids.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary lies: a path is taken as it is, the place of a name is asked of public_tokenizers."""
    if os.path.sep in name:
        return name
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), name)
    return str(public_tokenizers.path(name))


CACHE_ENTRIES = 400_000
CACHE_CHARS = 200
_SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]
_PAIRS = [p for s in _SPACES for p in ((s + " ", " " + s) if s != " " else ("  ",))]
_SPACE_SET = frozenset(_SPACES)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of base64 and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Min-queue of (rank, place) with find-first-set over a two-level bitmap of 256-bit words."""

    __slots__ = ("top", "words", "buckets")

    def __init__(self):
        self.top, self.words, self.buckets = 0, {}, {}

    def push(self, rank: int, place: int) -> None:
        b = self.buckets.get(rank)
        if b is None:
            self.buckets[rank] = [place]
            w = rank >> 8
            self.words[w] = self.words.get(w, 0) | (1 << (rank & 255))
            self.top |= 1 << w
        else:
            b.append(place)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its places; the bucket leaves the queue."""
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        low = word & -word
        word ^= low
        self.words[w] = word
        if not word:
            self.top ^= 1 << w
        rank = (w << 8) | (low.bit_length() - 1)
        return rank, self.buckets.pop(rank)

    def __bool__(self) -> bool:
        return self.top != 0


class Encoder:
    """Text -> ids with a given vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        self.names = {v: k for k, v in ranks.items()}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.first: dict[str, tuple[int, ...]] = {}
        self.later: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        names, ranks, pair_rank = self.names, self.ranks, self.pair_rank
        sym = [self.byte_ids[b] for b in data]
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank_of(a: int, b: int) -> int:
            r = pair_rank.get((a, b))
            if r is None:
                r = ranks.get(names[a] + names[b], -1)
                if len(pair_rank) >= 1_000_000:
                    pair_rank.clear()
                pair_rank[(a, b)] = r
            return r

        q = RankQueue()
        for i in range(n - 1):
            r = rank_of(sym[i], sym[i + 1])
            if r >= 0:
                q.push(r, i)
        while q:
            rank, places = q.pop()
            if len(places) > 1:
                places.sort()
            for i in places:
                j = nxt[i]
                if sym[i] < 0 or j >= n or rank_of(sym[i], sym[j]) != rank:
                    continue  # stale
                sym[i], sym[j] = rank, -1
                k = nxt[i] = nxt[j]
                if k < n:
                    prv[k] = i
                    r = rank_of(rank, sym[k])
                    if r >= 0:
                        q.push(r, i)
                p = prv[i]
                if p >= 0:
                    r = rank_of(sym[p], rank)
                    if r >= 0:
                        q.push(r, p)
        return tuple(s for s in sym if s >= 0)

    def _piece(self, piece: str) -> tuple[int, ...]:
        out: list[int] = []
        cache = self.tokens
        for t in self.find(piece):
            ids = cache.get(t)
            if ids is None:
                ids = self.merge(t.encode("utf-8", "replace"))
                if len(t) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[t] = ids
            out.extend(ids)
        return tuple(out)

    def _cached(self, cache: dict[str, tuple[int, ...]], piece: str, text: str) -> tuple[int, ...]:
        ids = self._piece(text)
        if len(piece) <= CACHE_CHARS:
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
            cache[piece] = ids
        return ids

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids by pieces. A single space between two non-spaces always starts a new pre-token, so text may be cut there;
        where spaces meet other white space it is left in one piece."""
        parts = text.split(" ")
        if any(p in text for p in _PAIRS) or text[:1] == " " or text[-1:] == " ":
            parts = _rejoin(parts)
        first, later = self.first, self.later
        p = parts[0]
        ids = first.get(p)
        yield ids if ids is not None else self._cached(first, p, p)
        get = later.get
        for p in parts[1:]:
            ids = get(p)
            yield ids if ids is not None else self._cached(later, p, " " + p)

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids: an empty list."""
        return list(chain.from_iterable(self.pieces(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0


def _rejoin(parts: list[str]) -> list[str]:
    """Joins neighbours again where the space between them does not stand between two non-spaces."""
    bad = [i for i, p in enumerate(parts) if not p or p[0] in _SPACE_SET or p[-1] in _SPACE_SET]
    if not bad:
        return parts
    glue = set()  # i: the space between parts i and i + 1 is kept
    last = len(parts) - 1
    for i in bad:
        p = parts[i]
        if i > 0 and (not p or p[0] in _SPACE_SET):
            glue.add(i - 1)
        if i < last and (not p or p[-1] in _SPACE_SET):
            glue.add(i)
    out, i, n = [], 0, len(parts)
    for g in sorted(glue):
        if g < i:
            out[-1] += " " + parts[g + 1]
        else:
            out.extend(parts[i : g + 1])
            out[-1] += " " + parts[g + 1]
        i = g + 2
    out.extend(parts[i:n])
    return out


def token_ids(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, ids ARRAY<INT>): the ids of every text without special tokens; the strings of special tokens are ordinary text.

    A null text and an empty one both give an empty list. Every row gives one row, rows with equal ids too.
    No shuffle: one Arrow pass over the text column, vocabulary (1 MB) broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path(vocabulary)))
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(sent.value, pattern)
        for b in batches:
            # output lists are larger than texts, so they leave in small batches
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                flat, ends = array("i"), [0]
                for t in part.column(1).to_pylist():
                    if t:
                        flat.extend(chain.from_iterable(enc.pieces(t)))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens LONG): the number of ids of every text; 0 for null and empty texts."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path(vocabulary)))
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(sent.value, pattern)
        for b in batches:
            counts = [enc.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_tokens")
