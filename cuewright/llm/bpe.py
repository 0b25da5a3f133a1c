"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the others through a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, as_text

#: Encoded misses in one generation of what a worker remembers.
GENERATION = 500_000
#: Bytes of the longest piece that is remembered, which bounds a generation in bytes too.
REMEMBERED = 64
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Memo:
    """Encoded misses in two generations: when the young one is full the old one goes, so what is used stays."""

    def __init__(self) -> None:
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def turn(self) -> None:
        self.young, self.old = {}, self.young


class PerfectHash:
    """A minimal perfect hash of fixed keys: each bucket of keys has a displacement that sends them to free slots."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for k in keys:
            h = xxhash.xxh64_intdigest(k)
            groups[h % self.buckets].append(h)
        self.shift = np.zeros(self.buckets, np.uint64)
        free = np.ones(self.n, bool)
        for b in sorted(range(self.buckets), key=lambda i: -len(groups[i])):
            hashes, d, step = np.array(groups[b], np.uint64), 0, 16
            while len(hashes):
                slots = self._slot(hashes, np.arange(d, d + step, dtype=np.uint64)[:, None])
                good = free[slots].all(axis=1)
                if len(hashes) > 1:
                    ordered = np.sort(slots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    self.shift[b] = d + int(good.argmax())
                    free[slots[good.argmax()]] = False
                    break
                d, step = d + step, min(4 * step, 1 << 14)

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (shift * np.uint64(_GOLD))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; keys outside the set get some slot, so compare what lies there."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        return self._slot(h, self.shift[h % np.uint64(self.buckets)])


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= 1 << 20 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must stay below 2^20 and hold every single byte")
        self.ranks = ranks
        self.pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.hash = PerfectHash(list(ranks))
        tokens = list(ranks)
        self.slot_token: list[bytes] = [b""] * len(tokens)
        self.slot_id = np.zeros(len(tokens), np.int32)
        for s, t in zip(self.hash.slots(tokens).tolist(), tokens):
            self.slot_token[s], self.slot_id[s] = t, ranks[t]
        #: The rank of what two neighbouring parts make, by both their ids, for each way to cut a token into two tokens.
        self.pairs = {ranks[t[:i]] << 20 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        by_id = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            by_id[i] = t
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece that is no token: the pair of lowest rank, leftmost on ties, is merged until none is left."""
        rank, n = self.pairs.get, len(piece)
        ids = [self.byte_id[x] for x in piece]
        due = [rank(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]  # the rank that each part and the next have
        heap = [r << 32 | i for i, r in enumerate(due) if r >= 0]
        if not heap:
            return tuple(ids)
        due.append(-1)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            first = heapq.heappop(heap)
            r, i = first >> 32, first & 0xFFFFFFFF
            if due[i] != r:
                continue  # one of the two has been merged since
            j = after[i]
            after[i] = k = after[j]
            ids[i], ids[j], due[i], due[j] = r, -1, -1, -1
            if k < n:
                before[k] = i
                due[i] = s = rank(r << 20 | ids[k], -1)
                if s >= 0:
                    heapq.heappush(heap, s << 32 | i)
            h = before[i]
            if h >= 0:
                due[h] = s = rank(ids[h] << 20 | r, -1)
                if s >= 0:
                    heapq.heappush(heap, s << 32 | h)
        return tuple([x for x in ids if x >= 0])

    def encode(self, texts: list[str], memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids of each text."""
        memo = memo or Memo()
        young, old = memo.young, memo.old
        split, codes, seen, counts = regex.compile(self.pattern).findall, [], {}, []
        for text in texts:
            pieces = split(text)
            codes += [seen.setdefault(p, len(seen)) for p in pieces]
            counts.append(len(pieces))
        pieces = list(seen)
        raw = [p.encode() for p in pieces]
        slots = self.hash.slots(raw)
        ids = self.slot_id[slots].tolist()
        out, lengths = [], np.ones(len(pieces), np.int64)
        for k, (piece, key, s) in enumerate(zip(pieces, raw, slots.tolist())):
            if self.slot_token[s] == key:
                out.append(ids[k])
                continue
            got = young.get(piece)
            if got is None:
                got = old.get(piece) or self.merge(key)
                if len(key) <= REMEMBERED:
                    young[piece] = got  # tuples of numbers, which the garbage collector leaves alone
            out += got
            lengths[k] = len(got)
        if len(young) >= GENERATION:
            memo.turn()
        flat, codes = np.array(out, np.int32), np.array(codes, np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        all_ids = flat[_runs(starts[codes], lengths[codes])]
        reach = np.concatenate(([0], np.cumsum(lengths[codes])))
        ends = reach[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        return all_ids, np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and the number of bytes of each text."""
        lengths = self.length[ids]
        raw = self.bytes[_runs(self.start[ids], lengths)]
        reach = np.concatenate(([0], np.cumsum(lengths)))
        return raw, np.diff(reach[np.cumsum(counts)], prepend=0) if len(counts) else counts


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    filled = lengths > 0
    starts, lengths = starts[filled], lengths[filled]
    step = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    step[0] = starts[0]
    step[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


@lru_cache(maxsize=4)
def load_codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    return Codec(ranks, pattern)


_memo: dict[str, Memo] = {}


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """df with the token ids of each whole text and, unless decoded is None, the bytes that the ids decode to.

    The rank file is read on the driver and sent to tasks once (its size is that of the vocabulary). Null and
    empty texts give empty arrays and no bytes. Columns named like the new ones are replaced; all rows are kept.
    """
    codec = df.sparkSession.sparkContext.broadcast(load_codec(path, pattern))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]

    def setup():
        own, memo = codec.value, _memo.setdefault(path + pattern, Memo())

        def compute(texts: list[bytes]) -> list[pa.Array]:
            flat, counts = own.encode([as_text(t) for t in texts], memo)
            field = pa.field("element", pa.int32(), nullable=False)
            out = [pa.ListArray.from_arrays(_offsets(counts), pa.array(flat), type=pa.list_(field))]
            if decoded:
                raw, sizes = own.decode(flat, counts)
                out.append(pa.Array.from_buffers(pa.binary(), len(sizes), [None, _offsets(sizes).buffers()[1], pa.py_buffer(raw.tobytes())]))
            return out

        return compute

    return append_columns(df, text_col, fields, setup)
