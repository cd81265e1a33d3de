"""SimHash near-duplicates over pigeonhole blocks.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles.
Fingerprints within ``max_bits`` bits agree on at least ``blocks - max_bits`` of ``blocks``
blocks; each combination of that many blocks is a join key, and only fingerprints that share a
key are compared. Equal fingerprints are one from the start, so copies are never expanded.

Within a key, up to ``group_limit`` distinct fingerprints are compared in one task, which emits
a spanning forest of the links and not every pair. A larger key is split by the same principle:
the bits it leaves free are cut into blocks again, and close pairs share some of those, and so on;
each level fixes about half of the free bits, so that a key of the third level has 256
fingerprints at most. Components come from alternating large-star and small-star rounds over
checkpointed edges.

Null or empty text: no shingles, fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is the only shingle. A null doc_id gets its component's smallest
id, or null if it has none. Repeated rows share a fingerprint. An empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, hot_values, map_rows, spread_join

BITS = 64
SEED = 42
#: Shingle hashes whose bits are counted at once.
SLICE = 1 << 14
SALTS = 64


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(data: bytes, width: int) -> int:
    """Unsigned."""
    h = shingle_hashes(data, width)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), SLICE):
        part = h[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""

    def kernel(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(x, width) for x in bytes_of(batch.column("text"))], np.uint64)
        return {"fp": fps.view(np.int64)}

    return map_rows(docs, kernel, keep or ["doc_id"], "fp long")


def finer_masks(mask: int, max_bits: int, blocks: int) -> list[int]:
    """``mask`` with each combination of blocks of its free bits that a close pair may agree on."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    blocks = min(blocks, len(free))
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in free[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
    return [mask | sum(chosen) for chosen in combinations(parts, blocks - max_bits)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """An array of (mask, key): the fingerprint masked to each combination of blocks."""
    masks = [signed(m) for m in finer_masks(0, max_bits, blocks)]
    return F.array(*(F.struct(F.lit(m).alias("mask"), fp.bitwiseAND(F.lit(m)).alias("key")) for m in masks))


def finer_keys(rows: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """(mask, key, fp) of the next level for rows (mask, fp) of keys that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, fp = (batch.column(c).to_numpy() for c in ("mask", "fp"))
            for own in np.unique(mask):
                member = fp[mask == own]
                for finer in finer_masks(int(own) & (1 << BITS) - 1, max_bits, blocks):
                    m = np.full(len(member), signed(finer), np.int64)
                    yield pa.RecordBatch.from_pydict({"mask": m, "key": member & m, "fp": member})

    return rows.mapInArrow(run, "mask long, key long, fp long").distinct()


def forest_of(words: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct fingerprints, a row of 64-bit words each."""
    unseen = np.arange(len(words))
    a: list[int] = []
    b: list[int] = []
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            i = queue.pop()
            near = np.bitwise_count(words[unseen] ^ words[i]).sum(axis=1, dtype=np.int64) <= max_bits
            hit = unseen[near]
            a += [i] * len(hit)
            b += hit.tolist()
            queue += hit.tolist()
            unseen = unseen[~near]
    return a, b


def group_links(groups: DataFrame, max_bits: int) -> DataFrame:
    """Links within groups of bounded size, given as an array ``fps`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            flat, ends = column.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            sizes = np.diff(ends)
            pairs = ends[:-1][sizes == 2]
            near = np.bitwise_count(flat[pairs] ^ flat[pairs + 1]) <= max_bits
            left.append(flat[pairs[near]])
            right.append(flat[pairs[near] + 1])
            for g in np.flatnonzero(sizes > 2):
                own = np.sort(flat[ends[g] : ends[g + 1]])
                a, b = forest_of(own[:, None], max_bits)
                left.append(own[a])
                right.append(own[b])
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(left).view(np.int64), "b": np.concatenate(right).view(np.int64)})

    return groups.select("fps").mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, max_bits: int, blocks: int, group_limit: int) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that chains of close pairs connect."""
    group_limit = max(group_limit, 1 << max_bits)  # so many fit in a key without enough bits to split
    name = ["mask", "key"]
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), max_bits, blocks)).alias("k")).select("k.mask", "k.key", "fp")
    edges = None
    while True:
        sizes = cut(keyed.groupBy(*name).agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1"))
        pairs = sizes.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
        pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()
        more = keyed.join(sizes.where(f"n > 2 and n <= {group_limit}").select(*name), name)
        groups = more.groupBy(*name).agg(F.collect_list("fp").alias("fps"))  # at most group_limit longs each
        found = pairs.unionByName(group_links(groups, max_bits))
        edges = found if edges is None else edges.unionByName(found)
        large = sizes.where(f"n > {group_limit}")
        if large.isEmpty():
            return edges.distinct()
        # A large key meets its rows in SALTS parts.
        parts = large.select(*name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(parts, [*name, "salt"])
        keyed = cut(finer_keys(rows.select("mask", "fp"), max_bits, blocks))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) with the smallest node reachable, for every node that has an edge.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller
    ones; both keep components and end in stars. Edges are checkpointed every round.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def simhash_components(
    docs: DataFrame, width: int = 3, max_bits: int = 3, blocks: int = 6, group_limit: int = 4096, id_col: str = "doc_id"
) -> DataFrame:
    """doc_id, fp (signed long), component_id (smallest doc_id reachable) for each row of ``docs``."""
    hashed = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), "text"), width))
    first = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    edges = links(first.select("fp"), max_bits, blocks, group_limit)
    comp = components(edges)
    # The smallest fingerprint names a component so far; its smallest document is wanted.
    named = first.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    smallest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    member = named.select("fp", "c").join(smallest, "c").select("fp", "component_id")
    out = spread_join(hashed.withColumn("_row", F.monotonically_increasing_id()), member, ["fp"], hot_values(first, "fp"), ["_row"])
    return out.select("doc_id", "fp", "component_id")
