"""Sampled suffixes of byte strings in vectorised form: what the suffix arrays of suffix_index.py hold.

A window of `WINDOW` bytes is told by a suffix within it: the one whose first `PREFIX` bytes hash lowest, leftmost
on ties. The choice depends on the window's bytes alone, so equal windows choose alike wherever they stand, and
only chosen suffixes need to be indexed: about one in 65 on text. The windows that choose one suffix stand in a row.
"""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW, PREFIX = 200, 40


def _fold(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """A hash of two neighbouring hashes."""
    x = (left * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)) ^ ((right >> np.uint64(7)) | (right << np.uint64(57)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def ladder(raw: np.ndarray, seed: int, top: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... up to top bytes, by the place where they begin."""
    table = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, np.uint64)
    steps, n = {1: table[raw]}, 1
    while 2 * n <= top:
        h = steps[n]
        steps[2 * n] = _fold(h[:-n], h[n:], seed) if len(h) > n else np.zeros(0, np.uint64)
        n *= 2
    return steps


def runs_hash(steps: dict[int, np.ndarray], length: int, seed: int) -> np.ndarray:
    """Hashes of all runs of `length` bytes, put together from the ladder's."""
    out, at = None, 0
    for n in sorted(steps, reverse=True):
        if length & n:
            h = steps[n][at:]
            out = h if out is None else _fold(out[: len(h)], h, seed)
            at += n
    return out


def window_hashes(raw: np.ndarray, seed: int = 7) -> np.ndarray:
    return runs_hash(ladder(raw, seed, 128), WINDOW, seed)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n, out = 1, values
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    rest = width - n
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sample(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, run, first, count) of the chosen suffixes of one string, in order.

    key hashes the suffix's first PREFIX bytes, run (another hash, so that both together are one of 128 bits) all
    bytes of the windows that choose it, seeded with its place among them; first is the first such window's
    beginning and count their number.
    """
    none = np.zeros(0, np.int64)
    windows = len(raw) - WINDOW + 1
    if windows < 1:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    steps = ladder(raw, 1, 32)
    key = runs_hash(steps, PREFIX, 1)
    order = key & ~np.uint64((1 << 24) - 1)
    chosen = np.empty(windows, np.int64)
    width = WINDOW - PREFIX + 1
    for at in range(0, windows, 1 << 23):  # places within a stretch fit into the 24 bits
        part = order[at : at + (1 << 23) + width - 1]
        part = part | np.arange(len(part), dtype=np.uint64)
        low = sliding_min(part, width)[: 1 << 23]
        chosen[at : at + len(low)] = at + (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    count = np.diff(np.append(first, windows))
    place = chosen[first]
    covered, ends = memoryview(raw), first + count - 1 + WINDOW
    pick = xxhash.xxh64_intdigest
    run = np.array([pick(covered[a:b], p) for a, b, p in zip(first.tolist(), ends.tolist(), (place - first).tolist())], np.uint64)
    return place, key[place], run, first, count
