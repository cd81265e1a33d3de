"""Cutting texts into segments whose windows can only equal windows of segments with the same key.

The key of a window of ``length`` bytes is the smallest hash among its grams of ``gram`` bytes,
so equal windows have equal keys wherever they stand. A segment is a run of consecutive windows
of one text with the same key.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: An odd base of the rolling hash and odd factors that spread its bits.
BASE = 0x9E3779B97F4A7C15
SPREAD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at once; a segment has at most MOST windows.
SLICE = 1 << 19
MOST = 256


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i < n."""
    out = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    size = 1 << max(int(len(data) - 1).bit_length(), 16)
    up, down = powers(size)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(data * up[: len(data)], out=sums[1:], dtype=np.uint64)
    h = sums[gram:] - sums[:-gram]
    h *= down[: len(h)]
    h ^= h >> np.uint64(31)
    h *= SPREAD[0]
    h ^= h >> np.uint64(29)
    h *= SPREAD[1]
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = h
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def sliding_max_at(low: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each of ``n`` grams the largest minimum of the windows that hold it."""
    padded = np.zeros(n + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    return ~sliding_min(~padded, width)


def segment_slice(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all segments: index of the text, start in the text, number of windows, key, inner.

    ``inner`` is set if the key's gram stands more than once within a segment's reach, without
    which the segment can't hold two equal windows.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    if sizes.max(initial=0) < length:
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64), np.empty(0, bool))
    width = length - gram + 1
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram)
    low = sliding_min(h, width)
    fits = np.flatnonzero(sizes >= length)
    begin, end = first[fits], first[fits] + sizes[fits] - length + 1  # of the windows of each text
    new = np.zeros(len(low) + 1, bool)
    new[1:-1] = low[1:] != low[:-1]
    new[begin] = True
    new[end] = True
    new = new[:-1]
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(low)))
    at = np.searchsorted(begin, starts, "right") - 1
    good = (at >= 0) & (starts < end[at])
    starts, runs, at = starts[good], runs[good], at[good]
    key = low[starts]
    anchors = np.flatnonzero(sliding_max_at(low, len(h), width) == h)
    order = np.lexsort((anchors, h[anchors]))
    a, b = anchors[order[:-1]], anchors[order[1:]]
    close = (h[a] == h[b]) & (b - a < MOST + length)
    twice = np.unique(h[a[close]])
    inner = np.isin(key, twice) if len(twice) else np.zeros(len(key), bool)
    parts = -(-runs // MOST)
    if parts.max(initial=1) > 1:
        starts, runs, at, key, inner, again = (np.repeat(x, parts) for x in (starts, runs, at, key, inner, np.cumsum(parts) - parts))
        i = np.arange(len(starts)) - again
        starts, runs = starts + i * MOST, np.minimum(runs - i * MOST, MOST)
    return fits[at], starts - begin[at], runs, key, inner


def slices(texts: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes together."""
    out, start, held = [], 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= SLICE:
            out.append((start, i + 1))
            start, held = i + 1, 0
    return [*out, (start, len(texts))] if start < len(texts) else out


def digests(texts: list[bytes], text: np.ndarray, start: np.ndarray, runs: np.ndarray, length: int) -> np.ndarray:
    """128-bit digests of the segments' bytes, as two longs each."""
    stop = start + runs + length - 1
    d = xxhash.xxh3_128_digest
    spans = zip(text.tolist(), start.tolist(), stop.tolist(), strict=True)
    return np.frombuffer(b"".join([d(texts[t][a:b]) for t, a, b in spans]), np.int64).reshape(-1, 2)
