"""Bloom filters of bounded size, built in shards by Spark and broadcast.

A filter is cut into equal shards by the low bits of the hash. The bits of a shard are set in
one task, so tasks emit disjoint pieces and the driver joins at most ``max_bits`` / 8 bytes,
however large the input is. Beyond the bound the filter fills up: false positives grow, and
callers that need exact results check what passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd factors that spread the bits of a hash.
MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    x = h.astype(np.uint64, copy=True)
    x ^= np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x ^= x >> np.uint64(33)
    x *= MIX[0]
    x ^= x >> np.uint64(33)
    x *= MIX[1]
    x ^= x >> np.uint64(33)
    return x


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """``shards`` is a power of two."""
    return (hashes.view(np.uint64) & np.uint64(shards - 1)).astype(np.int64)


def places(h: np.ndarray, i: int, size: int) -> np.ndarray:
    """The i-th place of mixed hashes in a shard of ``size`` bits, a power of two."""
    step = (h >> np.uint64(17)) | np.uint64(1)
    return (h + np.uint64(i) * step) & np.uint64(size - 1)


def set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    flags = np.zeros(len(bits) * 8, bool)
    flags[at] = True
    bits |= np.packbits(flags, bitorder="little")


@dataclass(frozen=True)
class Bloom:
    """``bits`` has the shards one after the other."""

    bits: np.ndarray
    shards: int
    probes: int

    def has(self, hashes: np.ndarray, salt: int = 0) -> np.ndarray:
        """Whether each 64-bit hash may be in the filter."""
        base = shard_of(hashes, self.shards)
        size = len(self.bits) * 8 // self.shards
        h = mixed(hashes, salt)
        alive = np.arange(len(h))
        for i in range(self.probes):
            at = base[alive] * size + places(h[alive], i, size).astype(np.int64)
            alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(h), bool)
        out[alive] = True
        return out


def power_of_two(n: float) -> int:
    return 1 << max(int(np.ceil(n)) - 1, 0).bit_length()


def bloom_of(hashes: DataFrame, column: str, entries: int, bits_per_entry: int = 16, max_bits: int = 1 << 26, probes: int = 4) -> Bloom:
    """A filter of the longs in ``column``, of at most ``max_bits`` bits."""
    bits = min(max(power_of_two(entries * bits_per_entry), 1 << 16), max_bits)
    shards = 64
    size = bits // shards

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            shard, at = shard_of(h, shards), mixed(h)
            for s in np.unique(shard).tolist():
                piece = own.setdefault(s, np.zeros(size // 8, np.uint8))
                for i in range(probes):
                    set_bits(piece, places(at[shard == s], i, size).astype(np.int64))
        for s, piece in own.items():
            yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "piece": [piece.tobytes()]})

    dealt = hashes.select(F.col(column).alias("h")).repartition(shards, F.col("h").bitwiseAND(F.lit(shards - 1)))
    out = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(pieces, "s int, piece binary").collect():  # bits / 8 bytes in all
        out[r["s"] * size // 8 : (r["s"] + 1) * size // 8] = np.frombuffer(r["piece"], np.uint8)
    return Bloom(out, shards, probes)
