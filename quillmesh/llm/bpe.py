"""Byte-pair encoding of whole corpora with the rank file of a public tokenizer.

Speculate and verify: every distinct word is first cut greedily into the
longest vocabulary entries. A sequence of tokens is the true encoding exactly
if each two neighbours, joined, would again be encoded as these two; that test
runs over arrays of all adjacent pairs at once. Only words with a failing pair
are merged rank by rank.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import ship

#: Fixed value: the pattern that splits text into words before the merges of the rank files.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "byte_bpe_50k"
#: Words kept with their ids per Python worker; when full it is emptied and filled anew.
CACHE_WORDS = 400_000
_NONE = np.int64(1) << 40


def rank_file(name: str = TOKENIZER, folder: str | None = None) -> str:
    """Where the rank file of tokenizer ``name`` lies: in ``folder``, else in $QUILLMESH_TOKENIZERS, else in /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("QUILLMESH_TOKENIZERS", "/opt/tokenizers"), f"{name}.tiktoken")


class Encoder:
    """Encodes words given as UTF-8 bytes. Built once per Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ids))
        size = max(self.ids.values()) + 1
        self.first, self.second = np.arange(size), np.arange(size)
        self.width = np.int64(size)
        keys, made = [], []
        for token, i in self.ids.items():
            if len(token) > 1:
                a, b = self.merge(token, i)
                self.first[i], self.second[i] = a, b
                keys.append(a * size + b)
                made.append(i)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging: the adjacent parts of lowest rank first, leftmost among equals; only ranks under ``below``."""
        parts = [bytes([x]) for x in word]
        while len(parts) > 1:
            best, at = below, -1
            for k in range(len(parts) - 1):
                rank = self.ids.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if at < 0:
                break
            pair, out, k = (parts[at], parts[at + 1]), [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.ids[p] for p in parts]

    def greedy(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        out, at, end = [], 0, len(word)
        while at < end:
            for stop in range(min(end, at + self.longest), at, -1):
                i = self.ids.get(word[at:stop])
                if i is not None:
                    out.append(i)
                    at = stop
                    break
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does their joined text encode to exactly them?

        Both tokens are unfolded in the reverse order of their merges. Had the
        inner parts at the seam been a merge of lower rank than the merges
        undone so far, it would have come first, and the pair is wrong.
        """
        a, b = left.astype(np.int64).copy(), right.astype(np.int64).copy()
        ok = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), _NONE)
        live = np.arange(len(a))
        while len(live):
            x, y, cap = a[live], b[live], limit[live]
            key = x * self.width + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[at] == key) & (self.made[at] < cap)
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # undo the later merge; a byte can't be undone, then the other side is
            x_atom, y_atom = self.first[x] == x, self.first[y] == y
            undo_x = np.where(x > y, ~x_atom, y_atom & ~x_atom)
            undo_y = ~undo_x & ~y_atom
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, limit[live]))
            a[live] = np.where(undo_x, self.second[x], x)
            b[live] = np.where(undo_y, self.first[y], y)
            live = live[undo_x | undo_y]
        return ok

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        guess = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, guess), dtype=np.int64, count=len(guess))
        flat = np.fromiter(chain.from_iterable(guess), dtype=np.int64, count=int(sizes.sum()))
        if len(flat) < 2:
            return guess
        owner = np.repeat(np.arange(len(guess)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][inside] * self.width + flat[1:][inside], return_inverse=True)
        fine = self.compatible(pairs // self.width, pairs % self.width)[back]
        for k in np.unique(owner[1:][inside][~fine]):
            guess[k] = self.merge_long(words[k])
        return guess

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging with a heap over linked parts, for words of any length."""
        if len(word) <= 64:
            return self.merge(word)
        import heapq

        n = len(word)
        part: list[bytes | None] = [word[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                p, q = part[k], part[after[k]]
                rank = self.ids.get(p + q)
                if rank is not None:
                    heapq.heappush(heap, (rank, k, p, q))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, p, q = heapq.heappop(heap)
            if part[k] != p or after[k] >= n or part[after[k]] != q:
                continue
            gone = after[k]
            part[k], part[gone] = p + q, None
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [self.ids[p] for p in part if p is not None]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def _splitter():
    return regex.compile(WORDS)


_known: dict[str, dict[str, list[int]]] = {}


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """The ids of each text; none for an empty and for a null text."""
    enc, split = encoder(path), _splitter().findall
    known = _known.setdefault(path, {})
    cut_texts = [split(t) if t else [] for t in texts]
    new = list({w for words in cut_texts for w in words if w not in known})
    if new:
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list({w for words in cut_texts for w in words})
        known.update(zip(new, enc.words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
    return [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut_texts]


def _batches(path: str, counts_only: bool):
    step = 500

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                ids = encode_texts(piece.column(1).to_pylist(), path)
                if counts_only:
                    made = pa.array([len(x) for x in ids], pa.int64())
                else:
                    ends = np.zeros(len(ids) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in ids], out=ends[1:])
                    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([piece.column(0), made], ["key", "made"])

    return run


def _apply(df: DataFrame, key: str, text: str, folder: str | None, counts_only: bool, name: str) -> DataFrame:
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_batches(rank_file(name, folder), counts_only), f"key {kind}, made {'bigint' if counts_only else 'array<int>'}")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """``key, ids``: one row per row of ``df``, the ids of its text without special tokens.

    Null and empty texts give an empty list; a null key, repeated rows and
    texts of any length are kept as they are; the strings of special tokens
    are ordinary text. Rows are encoded where they lie: no shuffle.
    """
    return _apply(df, key, text, folder, False, name).select(F.col("key").alias(key), F.col("made").alias("ids"))


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """``key, tokens``: the number of ids :func:`encode` gives for each row."""
    return _apply(df, key, text, folder, True, name).select(F.col("key").alias(key), F.col("made").alias("tokens"))
