"""Byte-level BPE encoding and decoding with a given vocabulary.

Two tiers: a minimal perfect hash finds whole pre-tokens that are themselves vocabulary entries; the others are
merged by a heap over a linked list of their bytes. Vocabulary and hash tables are built once on the driver (their
size is the vocabulary's, 50 thousand entries) and broadcast; texts never leave their task.

Nulls encode as the empty text, which has no tokens. Any text round-trips: decoded bytes equal the UTF-8 input.
Repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import gather, slices

_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: Pre-tokens handled together; bounds a task's memory.
TOKENS_AT_ONCE = 1_000_000
#: Merged pre-tokens a generation of the cache holds; there are two, of about 200 bytes an entry.
CACHE = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hash(keys: list[bytes]) -> np.ndarray:
    arr = np.empty(len(keys), dtype=object)
    arr[:] = keys
    return pd.util.hash_array(arr, categorize=False)


class PerfectHash:
    """Minimal perfect hash of n byte strings by displaced buckets: n slots, one probe, no empty slot."""

    def __init__(self, keys: list[bytes]):
        h = _hash(keys)
        self.n, self.m = len(keys), max(1, len(keys) // 4)
        self.shift = np.zeros(self.m, dtype=np.int64)
        self.slot_key = np.full(self.n, -1, dtype=np.int64)
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.m + 1))
        free = np.ones(self.n, dtype=bool)
        singles = []
        for b in np.argsort(-(cuts[1:] - cuts[:-1]), kind="stable"):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append((b, own[0]))
                continue
            first, tries = 1, 16
            while True:
                ds = np.arange(first, first + tries, dtype=np.int64)
                at = self._place(h[own][:, None], ds[None, :])
                fits = free[at].all(axis=0) & (np.diff(np.sort(at, axis=0), axis=0) != 0).all(axis=0)
                if fits.any():
                    break
                first, tries = first + tries, min(4096, tries * 2)
            k = int(np.argmax(fits))
            free[at[:, k]] = False
            self.shift[b], self.slot_key[at[:, k]] = ds[k], own
        for (b, k), at in zip(singles, np.flatnonzero(free)):
            self.shift[b], self.slot_key[at] = -at - 1, k

    def _place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d.astype(np.uint64) * _ODD1)) * _ODD2
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of the only key that each string can be; the caller compares the two."""
        h = _hash(keys)
        d = self.shift[(h % np.uint64(self.m)).astype(np.int64)]
        return self.slot_key[np.where(d < 0, -d - 1, self._place(h, d))]


class Cache:
    """Values by key in two generations. When the young one is full it takes the old one's place, whose keys are
    forgotten unless they were asked for meanwhile; so frequent keys stay, however many rare ones pass by."""

    def __init__(self, size: int = CACHE):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: bytes) -> bytes | None:
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: bytes, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Bpe:
    """Tables for encoding and decoding; small enough to broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ranks = pattern, ranks
        self.keys = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[k] for k in self.keys], dtype=np.uint32)
        self.whole = PerfectHash(self.keys)
        size = int(self.ids.max()) + 1
        self.lens = np.zeros(size, dtype=np.int64)
        self.lens[self.ids] = [len(k) for k in self.keys]
        self.starts = np.zeros(size, dtype=np.int64)
        self.starts[self.ids] = np.concatenate([[0], np.cumsum([len(k) for k in self.keys])[:-1]])
        self.bytes = np.frombuffer(b"".join(self.keys), dtype=np.uint8)
        # ids as they are written: four bytes each
        self.raw = [i.tobytes() for i in self.ids.astype("<u4")]
        self.cache = Cache()

    def __getstate__(self):
        return {**self.__dict__, "cache": Cache(), "_find": None}

    def merge(self, piece: bytes) -> list[int]:
        """Repeatedly join the adjacent pair of lowest rank, leftmost first."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # part starting at i ends at end[i]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue  # one of the two parts has grown or gone since
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        import regex

        if self.__dict__.get("_find") is None:
            self._find = regex.compile(self.pattern).findall
        out, tokens, ends = [], [], []
        for t in texts:
            tokens.extend(self._find(t))
            ends.append(len(tokens))
            if len(tokens) >= TOKENS_AT_ONCE:
                out += self._ids(tokens, ends)
                tokens, ends = [], []
        return out + self._ids(tokens, ends)

    def _ids(self, tokens: list[str], ends: list[int]) -> list[np.ndarray]:
        if not tokens:
            return [np.empty(0, dtype=np.uint32)] * len(ends)
        arr = np.empty(len(tokens), dtype=object)
        arr[:] = tokens
        codes, words = pd.factorize(arr)
        words = [w.encode() for w in words]
        found = self.whole.find(words)
        lists = []
        for w, k in zip(words, found.tolist()):
            if self.keys[k] == w:
                lists.append(self.raw[k])
                continue
            if (own := self.cache.get(w)) is None:
                own = np.array(self.merge(w), dtype="<u4").tobytes()
                self.cache.put(w, own)
            lists.append(own)
        lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // 4
        flat = np.frombuffer(b"".join(lists), dtype="<u4").astype(np.uint32, copy=False)
        starts = np.cumsum(lens) - lens
        per = lens[codes]
        ids = flat[gather(starts[codes], per)]
        at = np.concatenate([[0], np.cumsum(per)])[np.array(ends)]
        return np.split(ids, at[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[gather(self.starts[ids], self.lens[ids])].tobytes()


def _encoded(own: Bpe, values) -> list[bytes]:
    return [x.astype("<u4").tobytes() for x in own.encode([v or "" for v in values])]


def _decoded(own: Bpe, values) -> list[bytes]:
    return [own.decode(np.frombuffer(v or b"", dtype="<u4")) for v in values]


def encode(df: DataFrame, bpe, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the binary column ``into``: the ids of ``text`` as little-endian unsigned 32-bit integers.

    ``bpe`` is a broadcast ``Bpe``. A column of ``df`` named like ``into`` is replaced.
    """
    return _map(df, text, {into: _encoded}, bpe)


def decode(df: DataFrame, bpe, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the binary column ``into``: the bytes that ``ids`` stand for."""
    return _map(df, ids, {into: _decoded}, bpe)


def round_trip(df: DataFrame, bpe, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, so that a task needs one Python worker, not two."""
    return _map(df, text, {ids: _encoded, decoded: _decoded}, bpe)


def _map(df: DataFrame, column: str, steps: dict, bpe) -> DataFrame:
    """``df`` with a binary column for each of ``steps``, each made of the one before, the first of ``column``."""
    rest = [c for c in df.columns if c not in steps]
    given = df.select(*rest, *([] if column in rest else [column]))

    def run(batches):
        for batch in slices(batches, column):
            own = bpe.value
            cols = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for step in steps.values():
                values = step(own, values)
                cols.append(pa.array(values, type=pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, *steps])

    schema = df.select(*rest).withColumns({c: F.lit(b"") for c in steps}).schema
    return given.mapInArrow(run, schema)
