"""Language-model scoring with a log-frequency Bloom filter.

Training counts single tokens and pairs of tokens over every training text. A count c is held
as its level 1 + floor(log2(c)); the filter holds (n-gram, 1) ... (n-gram, level), so that a
count is read by probing level after level until one is missing. The filter is sized from the
counted (n-gram, level) entries, ``bits_per_entry`` for each, so that its rate of false positives
stays the same (under 2 % a probe) however large the corpus is. It is built in shards by Spark and
broadcast to the workers in parts of at most ``max_bits``; a worker loads one part after the other
and keeps the levels read so far. The layout doesn't depend on how the input is dealt. A pair's
probability is smoothed with its second token's own:

    P(w | v) = (c(v, w) + MU * P1(w)) / (c(v) + MU),   P1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

with counts read from the filter (the middle of a level stands for its counts); the first token
of a text has P1. ``score`` is the sum of log10 P over a text's tokens, its end included.

``base_score`` is the unigram sum with exact counts. The ``head`` most frequent tokens are
broadcast; counts of the other tokens meet the texts in a join.

Null or empty text: one token, the end. Null doc_ids hash as '' and are kept. Repeated rows count
once each in training and are scored each. An empty training set gives N = V = 0. An empty table
gives an empty result. Columns other than doc_id and text are ignored. Tokens are told apart by
64-bit hashes: with a billion different tokens, 0.03 collisions are expected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import mixed, power_of_two, shard_of
from .common import bytes_of, cut, map_rows, with_row_key

MU = 4.0
END = 0
#: Levels read at most; 2 ** 40 is more than any count here.
LEVELS = 40
#: Parts of the filter by the low bits of a hash; a shard is a run of them.
CELLS = 1 << 16
#: Counts merged at once.
PENDING = 1 << 21
#: Bytes of training text for a shard, which keep what a task holds as it is however large the corpus.
SHARD_TEXT = 1 << 23
#: Bytes of text counted and scored at once; a filter part is loaded for each portion.
SLICE = 6 << 20
PORTION = 1 << 24


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the number of tokens of each text."""
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    flat: list[int] = []
    sizes = []
    for x in texts:
        words = x.lower().split()
        flat += [number(w, len(ids) + 1) for w in words]
        flat.append(0)
        sizes.append(len(words) + 1)
    table = np.empty(len(ids) + 1, np.uint64)
    table[0] = END
    h = xxhash.xxh64_intdigest
    table[1:] = np.fromiter((h(w) or 1 for w in ids), np.uint64, len(ids))
    return table[np.array(flat, np.int64)], np.array(sizes, np.int64)


def pair_hashes(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that have a token before them in their text, and the hashes of those pairs."""
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(sizes) - sizes] = True
    at = np.flatnonzero(~first)
    return at, mixed(tokens[at - 1], 1) * np.uint64(0x9E3779B97F4A7C15) + mixed(tokens[at], 2)


def token_slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held > SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    u, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def ngram_counts(train: DataFrame, shards: int) -> DataFrame:
    """Packed counts of each batch: rows (kind, shard, hashes, counts); kind 1 are tokens, 2 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            held: dict[int, tuple[list, list]] = {1: ([], []), 2: ([], [])}
            for a, b in token_slices(texts):
                tokens, sizes = token_hashes(texts[a:b])
                for kind, h in ((1, tokens), (2, pair_hashes(tokens, sizes)[1])):
                    u, n = np.unique(h, return_counts=True)
                    held[kind][0].append(u)
                    held[kind][1].append(n)
            rows: dict[str, list] = {"kind": [], "shard": [], "hashes": [], "counts": []}
            for kind, parts in held.items():
                u, n = summed(*parts)
                shard = shard_of(u, CELLS) // (CELLS // shards)
                order = np.argsort(shard, kind="stable")
                u, n = u[order], n[order].astype(np.uint32)
                ends = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(ends)).tolist():
                    a, b = ends[s], ends[s + 1]
                    for name, v in zip(rows, (kind, s, u[a:b].tobytes(), n[a:b].tobytes()), strict=True):
                        rows[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["kind"], pa.int32()), pa.array(rows["shard"], pa.int32()), pa.array(rows["hashes"], pa.binary()), pa.array(rows["counts"], pa.binary())],
                names=list(rows),
            )

    return train.select("text").mapInArrow(run, "kind int, shard int, hashes binary, counts binary")


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def spots(h: np.ndarray, i: int, cell: int) -> np.ndarray:
    """The i-th place of mixed hashes in a cell of any number of bits."""
    step = (h << np.uint64(32)) | (h >> np.uint64(32)) | np.uint64(1)
    return (((h + np.uint64(i) * step) >> np.uint64(32)) * np.uint64(cell) >> np.uint64(32)).astype(np.int64)


MERGED_DDL = "shard int, kind int, hashes binary, levels binary, entries long, tokens array<long>, n array<long>"


def merged_counts(packed: DataFrame, shards: int) -> DataFrame:
    """Levels of each shard and kind over all batches, in a row each, and exact counts of tokens; ``entries`` is how many the filter will hold.

    Batches are added up as they stream in, so that a task holds the different n-grams of a shard
    and not one row for each batch that has them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        place, pending = None, 0

        def made() -> pa.RecordBatch:
            h, n = summed(*held)
            listed = [pa.array([x.view(np.int64) if place[1] == 1 else None], pa.list_(pa.int64())) for x in (h, n)]
            level = levels_of(n)
            flat = [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([level.astype(np.uint8).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*flat, pa.array([int(level.sum())], pa.int64()), *listed], names=["shard", "kind", "hashes", "levels", "entries", "tokens", "n"])

        for b in batches:
            for own in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "hashes", "counts")), strict=True):
                if place not in (None, own[:2]):
                    yield made()
                    held, pending = ([], []), 0
                place = own[:2]
                held[0].append(np.frombuffer(own[2], np.uint64))
                held[1].append(np.frombuffer(own[3], np.uint32))
                pending += len(held[0][-1])
                if pending > PENDING:
                    h, n = summed(*held)
                    held, pending = ([h], [n]), 0
        if place is not None:
            yield made()

    return packed.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, MERGED_DDL)


def filter_pieces(merged: DataFrame, shards: int, n_bits: int, probes: int) -> DataFrame:
    """(shard, piece): each shard's part of the filter. The rows of a shard follow each other in one partition."""
    cell = n_bits // CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, shard = None, None
        made = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "piece": [np.packbits(flags, bitorder="little").tobytes()]})
        for b in batches:
            for own, kind, hashes, levels in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "hashes", "levels")), strict=True):
                if own != shard:
                    if flags is not None:
                        yield made()
                    flags, shard = np.zeros(n_bits // shards, bool), own
                h, level = np.frombuffer(hashes, np.uint64), np.frombuffer(levels, np.uint8)
                base = (shard_of(h, CELLS) - own * (CELLS // shards)) * cell
                for q in range(1, int(level.max(initial=0)) + 1):
                    part = level >= q
                    at = mixed(h[part], kind * 100 + q)
                    for i in range(probes):
                        flags[base[part] + spots(at, i, cell)] = True
        if flags is not None:
            yield made()

    return merged.select("shard", "kind", "hashes", "levels").mapInArrow(run, "shard int, piece binary")


@dataclass(frozen=True)
class FilterPart:
    """The cells from ``low`` to ``high`` of the filter."""

    bits: np.ndarray
    low: int
    high: int
    probes: int

    def levels(self, hashes: np.ndarray, salt: int) -> np.ndarray:
        """The last level present of each n-gram, by repeated probes; 0 if level 1 is missing or the n-gram's cell is in another part."""
        own = shard_of(hashes, CELLS)
        level = np.zeros(len(hashes), np.uint8)
        alive = np.flatnonzero((own >= self.low) & (own < self.high))
        cell = len(self.bits) * 8 // (self.high - self.low)
        for q in range(1, LEVELS):
            h = mixed(hashes[alive], salt * 100 + q)
            base = (own[alive] - self.low) * cell
            for i in range(self.probes):
                at = base + spots(h, i, cell)
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                alive, h, base = alive[hit], h[hit], base[hit]
            if not len(alive):
                break
            level[alive] = q
        return level


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    low = np.exp2(np.maximum(level.astype(np.int64) - 1, 0))
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, low * 1.5 - 0.5))


def loaded(sent: Broadcast) -> FilterPart:
    """The value of a broadcast, kept no longer than the caller keeps it."""
    return sent.load_from_path(sent._path) if getattr(sent, "_path", None) else sent.value


def read_levels(parts: list[Broadcast], tokens: np.ndarray, sizes: np.ndarray, distinct: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Two rows: the levels of all tokens, and of the pairs that end at them (0 for a text's first)."""
    second, pairs = pair_hashes(tokens, sizes)
    u, back = np.unique(pairs, return_inverse=True)
    single, double = np.zeros(len(distinct), np.uint8), np.zeros(len(u), np.uint8)
    for sent in parts:
        part = loaded(sent) if len(parts) > 1 else sent.value
        np.maximum(single, part.levels(distinct, 1), out=single)
        np.maximum(double, part.levels(u, 2), out=double)
    out = np.zeros((2, len(tokens)), np.uint8)
    out[0] = single[where]
    out[1, second] = double[back]
    return out


def log_probabilities(levels: np.ndarray, sizes: np.ndarray, n_all: int, n_distinct: int) -> np.ndarray:
    single = count_of(levels[0])
    p = (single + 0.5) / (n_all + 0.5 * (n_distinct + 1))
    second = np.ones(len(p), bool)
    second[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(second)
    p[at] = (count_of(levels[1, at]) + MU * p[at]) / (single[at - 1] + MU)
    return np.log10(np.minimum(p, 1.0))


@dataclass(frozen=True)
class Model:
    """Where the filter's pieces are, and exact counts of single tokens."""

    pieces: DataFrame
    counts: DataFrame
    n_all: int
    n_distinct: int
    n_bits: int
    shards: int
    probes: int

    def part(self, low: int, high: int) -> FilterPart:
        """The shards from ``low`` to ``high``, brought together on the driver: as many bits as one round may broadcast."""
        step = self.n_bits // 8 // self.shards
        bits = np.zeros((high - low) * step, np.uint8)
        for r in self.pieces.where(F.col("shard").between(low, high - 1)).toLocalIterator():
            bits[(r["shard"] - low) * step : (r["shard"] - low + 1) * step] = np.frombuffer(r["piece"], np.uint8)
        width = CELLS // self.shards
        return FilterPart(bits, low * width, high * width, self.probes)


def train_lm(train: DataFrame, bits_per_entry: int = 10, probes: int = 3, shard_text: int = SHARD_TEXT) -> Model:
    """Count all n-grams of ``train`` (text) and build the filter."""
    # Shards follow the bytes of text and not the input's partitions, which compressed files have few of.
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(max(power_of_two(-(-size // shard_text)), 16), 1 << 14)
    merged = cut(merged_counts(ngram_counts(train, shards), shards))
    counts = merged.where("kind = 1").select(F.explode(F.arrays_zip("tokens", "n")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.n").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    entries = merged.agg(F.sum("entries")).first()[0] or 0
    n_bits = CELLS * 8 * max(-(-entries * bits_per_entry // (8 * CELLS)), 8)
    return Model(cut(filter_pieces(merged, shards, n_bits, probes)), counts, total["n"] or 0, total["v"], n_bits, shards, probes)


def score_lm(docs: DataFrame, max_bits: int = 1 << 29, head: int = 1 << 18, bits_per_entry: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    context = docs.sparkSession.sparkContext
    keyed = with_row_key(docs.select("doc_id", "text")).withColumn("held_out", held_out(F.col("doc_id")))
    model = train_lm(keyed.where("not held_out"), bits_per_entry)
    n_all, n_distinct = model.n_all, model.n_distinct
    top = model.counts.orderBy(F.desc("c"), "token").limit(head).toArrow()  # at most ``head`` rows of two longs
    by = np.argsort(top.column("token").to_numpy().view(np.uint64))
    common = context.broadcast((top.column("token").to_numpy().view(np.uint64)[by], top.column("c").to_numpy()[by]))
    log_all = float(np.log10(n_all + 0.5 * (n_distinct + 1)))
    step = max(model.shards * max_bits // model.n_bits, 1)
    parts = [context.broadcast(model.part(a, min(a + step, model.shards))) for a in range(0, model.shards, step)]

    def kernel(batch: pa.RecordBatch) -> dict:
        head_tokens, head_counts = common.value
        tokens, sizes = token_hashes(bytes_of(batch.column("text")))
        starts = np.cumsum(sizes) - sizes
        distinct, where = np.unique(tokens, return_inverse=True)
        levels = read_levels(parts, tokens, sizes, distinct, where)
        at = np.minimum(np.searchsorted(head_tokens, distinct), max(len(head_tokens) - 1, 0))
        known = head_tokens[at] == distinct if len(head_tokens) else np.zeros(len(distinct), bool)
        logs = np.where(known, np.log10((head_counts[at] if len(head_tokens) else 0) + 0.5), 0.0)
        in_head = known[where]
        sums = lambda x: np.add.reduceat(x, starts)
        ends = np.concatenate(([0], np.cumsum(sums((~in_head).astype(np.int64))))).astype(np.int32)
        return {
            "n_tokens": sizes,
            "head_known": sums(in_head.astype(np.int64)),
            "head_sum": sums(logs[where]),
            "score": sums(log_probabilities(levels, sizes, n_all, n_distinct)),
            "tail": pa.ListArray.from_arrays(pa.array(ends), pa.array(distinct[where[~in_head]].view(np.int64))),
        }

    added = "n_tokens long, head_known long, head_sum double, score double, tail array<long>"
    scored = cut(map_rows(keyed, kernel, ["doc_id", "_k", "_t", "held_out"], added, PORTION))
    tail = scored.dropDuplicates(["_k", "_t"]).select("_k", "_t", F.explode("tail").alias("token"))
    rare = tail.join(model.counts, "token", "left").groupBy("_k", "_t").agg(
        F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("sum")
    )
    base = F.col("head_sum") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)
    return scored.drop("tail").join(rare, ["_k", "_t"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
