"""Near-duplicate removal: documents whose sets of five-word shingles have a Jaccard similarity of ``threshold``.

Candidates come from two sides. The operator of ``simhash`` links fingerprints within ``max_bits`` bits over pigeonhole
blocks. MinHash adds what fingerprints lose at this threshold: a text has ``bands`` keys, each a hash of ``band_rows`` minima of its
shingles under fixed seeded hashes. A pair of similarity s shares a key with probability
1 - (1 - s ** band_rows) ** bands: with the defaults 0.9999 at 0.8 and nearer to 1 above. Whatever
shares a key or is linked, directly or through others, is one candidate group, and within a group every pair
not yet connected is compared by the exact similarity of its shingle sets (64-bit hashes of the
shingles), so that pairs below the threshold never count.

Equal shingle sets are one node. A text travels once to its candidate group. A group of up to
``group_limit`` nodes and ``group_shingles`` shingles is compared in one task, which emits a
spanning forest of its links; a larger one is dealt out as pairs of parts of that size, which
compares the same pairs in many tasks.

Null or empty text: no shingles, so that all such documents are one group. Fewer words than
a shingle: the whole sequence is the only shingle. The smallest doc_id of a group stays (nulls
first); of rows alike in id and text one stays. An empty table gives an empty result. Other
columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, map_rows, with_row_key
from .simhash import components, fingerprint, links, shingle_hashes

#: Shingle hashes whose minima are taken at once.
SLICE = 512
#: Words of a shingle, bits, blocks and group size of the fingerprints, as in ``simhash``.
FINGERPRINT_WIDTH, MAX_BITS, BLOCKS, KEY_LIMIT = 3, 3, 6, 4096


def shingle_set(data: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(data, width))


def hash_family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, (n, 1), np.uint32)


def minima(h: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of a set of shingle hashes under each hash of the family."""
    factor, term = family
    x = (h >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factor), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), SLICE):
        np.minimum(low, (x[i : i + SLICE] * factor + term).min(axis=1), out=low)
    return low


def sketches(keyed: DataFrame, width: int, band_rows: int, bands: int) -> DataFrame:
    """Row key, id, ``node`` (names the shingle set), ``size`` (of that set), ``keys``, one for each band, and ``fp``, the fingerprint of ``simhash``."""
    family = hash_family(band_rows * bands)

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"node": [], "size": [], "keys": [], "fp": []}
        for data in bytes_of(batch.column("text")):
            h = shingle_set(data, width)
            low = minima(h, family).reshape(bands, band_rows)
            out["node"].append(xxhash.xxh3_64_intdigest(h.tobytes()))
            out["size"].append(len(h))
            out["keys"].append(np.array([xxhash.xxh3_64_intdigest(x.tobytes(), t) for t, x in enumerate(low)] if len(h) else [], np.uint64).view(np.int64))
            out["fp"].append(fingerprint(data, FINGERPRINT_WIDTH))
        return out | {c: np.array(out[c], np.uint64).view(np.int64) for c in ("node", "fp")}

    return map_rows(keyed, kernel, ["doc_id", "_k", "_t"], "node long, size long, keys array<long>, fp long")


def similar_forest(sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of non-empty sets whose Jaccard similarity is at least the threshold."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(values), bool)
    unseen = np.arange(len(sets))
    a: list[int] = []
    b: list[int] = []
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        flat = None
        while queue and len(unseen):
            i = queue.pop()
            if flat is None:
                flat, starts = np.concatenate([parts[j] for j in unseen]), np.cumsum(sizes[unseen]) - sizes[unseen]
            marked[parts[i]] = True
            shared = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            marked[parts[i]] = False
            near = shared >= threshold * (sizes[i] + sizes[unseen] - shared)
            if near.any():
                hit = unseen[near]
                a += [i] * len(hit)
                b += hit.tolist()
                queue += hit.tolist()
                unseen, flat = unseen[~near], None
    return a, b


def compared(groups: DataFrame, width: int, threshold: float) -> DataFrame:
    """A spanning forest of the links within each group, given as an array ``g`` of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column("g"):
                nodes = own.values.field("node").to_numpy()
                left, right = similar_forest([shingle_set(x, width) for x in bytes_of(own.values.field("text"))], threshold)
                yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[left], pa.int64()), "b": pa.array(nodes[right], pa.int64())})

    return groups.select("g").mapInArrow(run, "a long, b long").distinct()


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) among nodes whose fingerprints are equal or within ``MAX_BITS`` bits; a fingerprint's smallest node stands for it."""
    worded = nodes.where("size > 0").select("node", "fp")
    first = cut(worded.groupBy("fp").agg(F.min("node").alias("hub")))
    alike = worded.join(first, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp"), MAX_BITS, BLOCKS, KEY_LIMIT)
    for c in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}")), c)
    return alike.unionByName(near.select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b")))


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, component): what close fingerprints and band keys connect, for every node that has such a link."""
    met = nodes.select("node", F.explode("keys").alias("key"))
    hubs = cut(met.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    shared = met.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    found = components(fingerprint_links(nodes).unionByName(shared))
    roots = found.select(F.col("component").alias("node"), "component").distinct()  # a component's smallest node, which ``components`` leaves out
    return found.unionByName(roots)


def similar_links(keyed: DataFrame, nodes: DataFrame, width: int, threshold: float, group_limit: int, group_shingles: int) -> DataFrame:
    """Links (a, b) among ``nodes`` (node, size, place, keys, fp), whose texts are in ``keyed``."""
    members = cut(nodes.join(candidate_groups(nodes), "node").select("node", "size", "place._k", "place._t", "component"))
    totals = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    share = F.greatest(F.col("n") / group_limit, F.col("total") / group_shingles)
    totals = totals.select("component", F.when(share <= 1, 1).otherwise(F.ceil(2 * share)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.join(totals, "component").select("node", "_k", "_t", "component", part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    dealt = dealt.select("node", "_k", "_t", "component", F.least("p", "o").alias("p"), F.greatest("p", "o").alias("o"))
    texts = keyed.select("_k", "_t", "text").join(members.select("_k", "_t"), ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"])
    groups = dealt.join(texts, ["_k", "_t"]).groupBy("component", "p", "o").agg(F.collect_list(F.struct("node", "text")).alias("g")).where(F.size("g") > 1)
    return compared(groups, width, threshold)


def near_dedup(
    docs: DataFrame, width: int = 5, threshold: float = 0.8, band_rows: int = 8, bands: int = 50, group_limit: int = 2000, group_shingles: int = 1 << 20
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but one document of each group of near duplicates."""
    keyed = with_row_key(docs.select("doc_id", "text"))
    sketched = cut(sketches(keyed, width, band_rows, bands))
    place = F.struct("doc_id", "_k", "_t")
    nodes = cut(sketched.groupBy("node").agg(F.min(place).alias("place"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("fp").alias("fp")))
    comp = components(similar_links(keyed, nodes, width, threshold, group_limit, group_shingles))
    named = nodes.select("node", "place").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    stay = named.groupBy("c").agg(F.min("place").alias("place")).select("place._k", "place._t")
    packed = with_row_key(docs.select("doc_id", "text", F.struct(*docs.columns).alias("rest"))).select("_k", "_t", "rest")
    return packed.join(stay, ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"]).select("rest.*")
