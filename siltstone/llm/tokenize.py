"""Encoding of whole texts with a public byte-level BPE, on padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
import importlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, starts

#: Pieces of more bytes than this are merged with a heap, so that no text is slow for its length.
LONG = 512
#: Piece ids kept between batches.
_KEPT = 400_000
_none = np.int64(1 << 40)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary file lies: in folder, in $TOKENIZER_DIR, or in the installed public_tokenizers."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def _pattern() -> str:
    try:
        return importlib.import_module("public_tokenizers").PATTERN
    except ImportError:
        return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """A vocabulary of byte strings with ranks as ids; a pair of tokens merges into the token that joins their bytes.

    Every row of a matrix is a piece of text as token ids.  In each round every row merges its leftmost pair of least
    rank; pairs are looked up in an open hash table, rows that have no pair left leave the matrix, and the columns that
    merging empties are closed.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i in range(256):
            self.byte_id[i] = ranks[bytes([i])]
        self.ranks = ranks
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        self.bits = max(4, int(len(key) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.table_key = np.full(size, -1, dtype=np.int64)
        self.table_rank = np.full(size, _none, dtype=np.int64)
        self.probes = 1
        todo = np.arange(len(key))
        slot = self._slot(key)
        rank_a = np.array(rank, np.int64)
        while len(todo):
            free = self.table_key[slot[todo]] == -1
            _, one = np.unique(np.where(free, slot[todo], -1), return_index=True)
            one = one[free[one]]
            put = todo[one]
            self.table_key[slot[put]] = key[put]
            self.table_rank[slot[put]] = rank_a[put]
            rest = np.ones(len(todo), bool)
            rest[one] = False
            todo = todo[rest]
            moved = self.table_key[slot[todo]] != -1
            slot[todo[moved]] = (slot[todo[moved]] + 1) & (size - 1)
        home = self._slot(self.table_key[self.table_key >= 0])
        self.probes = int(((np.flatnonzero(self.table_key >= 0) - home) & (size - 1)).max()) + 1 if len(key) else 1
        self.split = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        """Empties the pool of piece ids: known maps a piece to its row of pool_at and pool_len, pool_ids holds all ids."""
        self.known: dict[str, int] = {}
        self.pool_at, self.pool_len, self.pool_ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 14, np.int32), 0

    def _keep(self, pieces: list[str], ids: list[np.ndarray]) -> None:
        """Appends pieces to the pool, whose arrays double when they are full."""
        n, k = np.array([len(x) for x in ids], np.int64), len(self.known)
        while len(self.pool_at) < k + len(n):
            self.pool_at, self.pool_len = np.concatenate([self.pool_at, self.pool_at]), np.concatenate([self.pool_len, self.pool_len])
        while len(self.pool_ids) < self.used + n.sum():
            self.pool_ids = np.concatenate([self.pool_ids, self.pool_ids])
        at = starts(n)
        self.pool_at[k : k + len(n)], self.pool_len[k : k + len(n)] = self.used + at[:-1], n
        self.pool_ids[self.used : self.used + at[-1]] = np.concatenate(ids)
        self.used += int(at[-1])
        self.known.update(zip(pieces, range(k, k + len(n))))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair forms, or a large number."""
        key = a << 20 | b
        slot = self._slot(key)
        out = np.full(key.shape, _none)
        todo = (a >= 0) & (b >= 0)
        for _ in range(self.probes):
            here = self.table_key[slot]
            hit = todo & (here == key)
            out[hit] = self.table_rank[slot[hit]]
            todo &= ~hit & (here != -1)
            if not todo.any():
                break
            slot = (slot + 1) & (len(self.table_key) - 1)
        return out

    def merge_rows(self, m: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix of byte ids padded with -1."""
        out: list[np.ndarray] = [m[0]] * len(m)
        rows = np.arange(len(m))
        rank = self.pair_ranks(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else np.zeros((len(m), 0), np.int64)
        while len(rows):
            if not rank.shape[1]:
                for r, x in zip(rows.tolist(), m):
                    out[r] = x[x >= 0]
                break
            at = rank.argmin(axis=1)
            ids = np.arange(len(rows))
            best = rank[ids, at]
            over = best == _none
            if over.any():
                for r, x in zip(rows[over].tolist(), m[over]):
                    out[r] = x[x >= 0]
                live = ~over
                rows, m, rank, at, best = rows[live], m[live], rank[live], at[live], best[live]
                if not len(rows):
                    break
                width = int((m >= 0).sum(axis=1).max())  # close emptied columns
                m, rank = m[:, :width], rank[:, : max(width - 1, 0)]
                ids = np.arange(len(rows))
            # the pair at ``at`` becomes one token, all that is right of it moves one to the left
            col = np.arange(m.shape[1] - 1)
            m = np.concatenate([np.where(col <= at[:, None], m[:, :-1], m[:, 1:]), np.full((len(m), 1), -1)], axis=1)
            m[ids, at] = best
            if rank.shape[1] > 1:
                col = col[:-1]
                rank = np.concatenate([np.where(col <= at[:, None], rank[:, :-1], rank[:, 1:]), np.full((len(m), 1), _none)], axis=1)
            else:
                rank = np.full((len(m), 1), _none)
            right = np.minimum(at + 1, m.shape[1] - 1)
            rank[ids, at] = np.where(right > at, self.pair_ranks(m[ids, at], m[ids, right]), _none)
            has = at > 0
            left = at[has] - 1
            rank[ids[has], left] = self.pair_ranks(m[ids[has], left], m[ids[has], at[has]])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece by a heap over a linked list, in n log n time."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        ranks, back = self.ranks, {v: k for k, v in self.ranks.items()} if not hasattr(self, "_back") else self._back
        self._back = back
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank_at(i: int) -> int | None:
            j = after[i]
            return ranks.get(back[ids[i]] + back[ids[j]]) if j < n else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], alive[j] = r, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (s := rank_at(k)) is not None:
                    heapq.heappush(heap, (s, k, ids[k], ids[after[k]]))
        return np.array([t for t, a in zip(ids, alive) if a], dtype=np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Adds the ids of pieces not met before, in matrices of rows of like length."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        length = np.array([len(r) for r in raw])
        done: list[np.ndarray | None] = [None] * len(raw)
        for i in np.flatnonzero(length > LONG).tolist():
            done[i] = self.merge_long(raw[i])
        order = np.argsort(length, kind="stable")
        order = order[length[order] <= LONG]
        lo = 0
        while lo < len(order):
            top = max(int(length[order[lo]] * 1.25) + 1, 4)
            hi = int(np.searchsorted(length[order], top, side="right"))
            hi = min(hi, lo + max(64, 400_000 // top))
            some = order[lo:hi]
            width = int(length[some[-1]])
            flat = self.byte_id[np.frombuffer(b"".join(raw[i] for i in some.tolist()), np.uint8)]
            n = length[some]
            m = np.full((len(some), width), -1, dtype=np.int64)
            m[np.arange(width) < n[:, None]] = flat
            for i, ids in zip(some.tolist(), self.merge_rows(m)):
                done[i] = ids
            lo = hi
        self._keep(pieces, done)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and offsets; null and empty texts have none."""
        if len(self.known) > _KEPT:
            self._forget()
        every: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                p = self.split(t)
                counts[i] = len(p)
                every += p
        known = self.known
        fresh = list(dict.fromkeys(p for p in set(every) if p not in known))
        if fresh:
            self.learn(fresh)
        which = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        if not len(which):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        n = self.pool_len[which]
        off = starts(n)
        take = np.repeat(self.pool_at[which] - off[:-1], n) + np.arange(off[-1])
        return self.pool_ids[take], off[starts(counts)]


_open: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    e = _open.get((path, pattern))
    if e is None:
        e = _open[path, pattern] = ByteBpe(path, pattern)
    return e


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every document; null and empty texts have an empty list, never null.

    vocabulary is the path of a rank file, which every worker opens for itself.
    """
    ship(docs.sparkSession)
    path, pat = vocabulary or vocabulary_path(), pattern or _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pat)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                flat, off = e.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))], names=[key, "ids"])

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` bigint, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, tokens int) of every document; null and empty texts have 0."""
    ship(docs.sparkSession)
    path, pat = vocabulary or vocabulary_path(), pattern or _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pat)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                _, off = e.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off).astype(np.int32))], names=[key, "tokens"])

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` bigint, tokens int")
