"""Removal of word spans that an earlier document has, by compacting a de Bruijn graph of word k-mers.

A window of ``window`` words is an edge between the ``window`` - 1 words before and after. Windows of one text with the same
least hash of their grams of ``gram`` words follow each other; such a run is one *segment*, and equal windows always lie in
segments with the same key. The graph is built of segments:

1. Keys are counted in the tasks and in a shuffle; only segments with a key seen twice go on.
2. An aggregation over their contents finds the first and last document of each, and whether what comes before or after
   it is the same at all its occurrences. Where it isn't, the path branches. Keys with several contents are *mixed*
   (segments that overlap in part), and their windows are edges one by one.
3. Each text is walked again: segments between branches join to one path, which therefore occurs in whole wherever any
   window of it does. Paths and single windows are named by 128-bit digests of the words at their source coordinates,
   and a join with the first document of each digest says which occurrences go.
4. A text that stays or goes as a whole is counted where it is read; only texts that lose a part are shuffled.

Keys, branches and repeated contents travel as Bloom filters of bounded size. What passes wrongly gives more rows,
never another result: a branch seen wrongly is seen at every occurrence, since it depends on content alone.

Null or empty text: no words, nothing removed, the digest of the empty string. Null doc_ids are neither smaller nor
larger than others: such rows stay whole and remove nothing. Rows with one doc_id don't remove each other's words, repeated
rows included. Texts of fewer words than a window stay. Very long texts are taken in pieces that overlap. An empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import bytes_of, cut, drop_folder, hot_values, map_rows, portions, spread_join, stored, with_row_key
from .segments import MOST, SPREAD, powers, sliding_min

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: They tell a branch before a content, one after it, and the content itself apart in a filter.
BEFORE, AFTER = 0x5851F42D4C957F2D, 0x14057B7EF767814F
EDGES = "id long, key long, first long, last long, before long, before2 long, after long, after2 long"


def spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= SPREAD[0]
    h ^= h >> np.uint64(29)
    h *= SPREAD[1]
    return h ^ (h >> np.uint64(32))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and stops."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SPACE[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(gap[:-2] & ~gap[1:-1]), np.flatnonzero(~gap[1:-1] & gap[2:]) + 1


@dataclass
class Pieces:
    """Pieces of texts joined by spaces; ``row``, ``base`` and ``total`` are each piece's row, first word in its text, and that text's words."""

    data: bytes
    starts: np.ndarray
    stops: np.ndarray
    piece: np.ndarray
    row: np.ndarray
    base: np.ndarray
    total: np.ndarray

    def words(self, a: int, b: int) -> bytes:
        return b" ".join(self.data[self.starts[a] : self.stops[b - 1]].split())


def pieces_of(texts: list[bytes], window: int) -> Iterator[Pieces]:
    """Texts in lots of about SLICE bytes; a longer one is cut into pieces that share ``window`` - 1 words."""

    def lot(held: list[tuple[int, int, int, bytes]]) -> Pieces:
        data = b" ".join(x for *_, x in held)
        size = np.fromiter((len(x) + 1 for *_, x in held), np.int64, len(held))
        starts, stops = word_places(data)
        piece = np.searchsorted(np.cumsum(size) - size, starts, "right") - 1
        row, base, total = (np.array([x[i] for x in held]) for i in range(3))
        return Pieces(data, starts, stops, piece, row, base, np.where(total < 0, np.bincount(piece, minlength=len(held)), total))

    held: list[tuple[int, int, int, bytes]] = []
    total = 0
    for row, text in enumerate(texts):
        if len(text) <= SLICE:
            parts = [(row, 0, -1, text)]
        else:
            starts, stops = word_places(text)
            step = max(SLICE * len(starts) // len(text), window)
            parts = ((row, a, len(starts), text[starts[a] : stops[min(a + step + window - 1, len(stops)) - 1]]) for a in range(0, max(len(starts) - window + 1, 1), step) if len(starts))
        for part in parts:
            held.append(part)
            total += len(part[3])
            if total >= SLICE:
                yield lot(held)
                held, total = [], 0
    if held:
        yield lot(held)


@dataclass
class Segments:
    """Runs of windows: first word in the lot, number of windows, key, content and the neighbours' contents (0 at a piece's edge)."""

    start: np.ndarray
    runs: np.ndarray
    key: np.ndarray
    id: np.ndarray
    before: np.ndarray
    after: np.ndarray


def rolled(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(1 << max(int(size).bit_length(), 16))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:], dtype=np.uint64)
    return sums, down


def segments_of(p: Pieces, window: int, gram: int) -> Segments:
    n = len(p.starts)
    if n < window:
        none = np.empty(0, np.uint64)
        return Segments(np.empty(0, np.int64), np.empty(0, np.int64), none, none, none, none)
    sums, down = rolled(np.frombuffer(p.data, np.uint8).astype(np.uint64) + np.uint64(1), len(p.data))
    words = spread((sums[p.stops] - sums[p.starts]) * down[p.starts])
    sums, down = rolled(words, n)
    grams = spread((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = sliding_min(grams, window - gram + 1)
    inside = p.piece[: len(low)] == p.piece[window - 1 :]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (p.piece[1 : len(low)] != p.piece[: len(low) - 1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    runs = np.diff(np.append(start, len(low)))
    start, runs = start[inside[start]], runs[inside[start]]
    parts = -(-runs // MOST)
    if parts.max(initial=1) > 1:
        again = np.repeat(np.cumsum(parts) - parts, parts)
        start, runs = np.repeat(start, parts), np.repeat(runs, parts)
        i = np.arange(len(start)) - again
        start, runs = start + i * MOST, np.minimum(runs - i * MOST, MOST)
    id_ = spread((sums[start + runs + window - 1] - sums[start]) * down[start] + runs.astype(np.uint64))
    before, after = np.zeros(len(id_), np.uint64), np.zeros(len(id_), np.uint64)
    joined = p.piece[start[1:]] == p.piece[start[:-1]]
    before[1:][joined] = id_[:-1][joined]
    after[:-1][joined] = id_[1:][joined]
    return Segments(start, runs, low[start], id_, before, after)


def count_keys(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, n): how many segments have each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            found = [segments_of(p, window, gram).key for p in pieces_of(bytes_of(b.column("text")), window)]
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "n": n})

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def edges_of(docs: DataFrame, known: Bloom, window: int, gram: int) -> DataFrame:
    """A row for each content whose key may be shared: its key, first and last document, and whether it has one neighbour on either side."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            doc = b.column("doc_id").to_numpy()
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for p in pieces_of(bytes_of(b.column("text")), window):
                s = segments_of(p, window, gram)
                hit = sent.value.has(s.key)
                for c, x in zip(cols, (s.id, s.key, doc[p.row[p.piece[s.start]]], s.before, s.after), strict=True):
                    c.append(x[hit])
            if not cols[0]:
                continue
            id_, key, d, before, after = (np.concatenate(c).view(np.int64) for c in cols)
            if not len(id_):
                continue
            order = np.argsort(id_, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(id_[order]) != 0])
            low, high = (lambda x: np.minimum.reduceat(x[order], at)), (lambda x: np.maximum.reduceat(x[order], at))
            made = (id_[order][at], key[order][at], low(d), high(d), low(before), high(before), low(after), high(after))
            yield pa.RecordBatch.from_pydict(dict(zip((c.split()[0] for c in EDGES.split(", ")), made, strict=True)))

    met = docs.select("doc_id", "text").mapInArrow(run, EDGES)
    ends = {"first": F.min, "last": F.max, "before": F.min, "before2": F.max, "after": F.min, "after2": F.max}
    by_id = met.groupBy("id", "key").agg(*(f(c).alias(c) for c, f in ends.items()))
    return by_id.select("id", "key", "first", "last", (F.col("before") != F.col("before2")).alias("joins"), (F.col("after") != F.col("after2")).alias("forks"))


def paths_of(docs: DataFrame, repeated: Bloom, branches: Bloom, mixed: Bloom, window: int, gram: int) -> DataFrame:
    """Occurrences of paths and of single windows: row key, doc_id, digest, the words start to stop of the text, and how many it has."""
    sent = docs.sparkSession.sparkContext.broadcast((repeated, branches, mixed))
    schema = "_k long, _t long, doc_id long, d1 long, d2 long, start int, stop int, total int"

    def lot(p: Pieces) -> Iterator[tuple[int, int, int, bytes]]:
        """(piece, first word, last word + 1, digest)"""
        whole, branch, single = sent.value
        s = segments_of(p, window, gram)
        d = xxhash.xxh3_128_digest
        alone = single.has(s.key)
        on_path = ~alone
        on_path[on_path] = whole.has(s.id[on_path])
        i = np.flatnonzero(on_path)
        if len(i):
            fork, join = branch.has(s.id[i] ^ np.uint64(AFTER)), branch.has(s.id[i] ^ np.uint64(BEFORE))
            new = np.ones(len(i), bool)
            new[1:] = (np.diff(i) > 1) | fork[:-1] | join[1:] | (s.before[i[1:]] == 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(i)) - 1
            for a, b in zip(s.start[i[first]].tolist(), (s.start[i[last]] + s.runs[i[last]] + window - 1).tolist(), strict=True):
                yield int(p.piece[a]), a, b, d(p.words(a, b))
        for a, n in zip(s.start[alone].tolist(), s.runs[alone].tolist(), strict=True):
            held, begun = d(p.words(a, a + window)), a
            for x in range(a + 1, a + n):
                own = d(p.words(x, x + window))
                if own != held:
                    yield int(p.piece[a]), begun, x + window - 1, held
                    held, begun = own, x
            yield int(p.piece[a]), begun, a + n + window - 1, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            k, t, doc = (b.column(c).to_numpy() for c in ("_k", "_t", "doc_id"))
            for p in pieces_of(bytes_of(b.column("text")), window):
                if found := list(lot(p)):
                    piece, a, z = (np.array(x) for x in zip(*(f[:3] for f in found), strict=True))
                    first = np.searchsorted(p.piece, np.arange(len(p.row)))  # each piece's first word in the lot
                    at, to = (x - first[piece] + p.base[piece] for x in (a, z))
                    digest = np.frombuffer(b"".join(f[3] for f in found), np.int64).reshape(-1, 2)
                    r = p.row[piece]
                    places = {c: x.astype(np.int32) for c, x in (("start", at), ("stop", to), ("total", p.total[piece]))}
                    yield pa.RecordBatch.from_pydict({"_k": k[r], "_t": t[r], "doc_id": doc[r], "d1": digest[:, 0], "d2": digest[:, 1]} | places)

    return docs.select("_k", "_t", "doc_id", "text").mapInArrow(run, schema)


def repeated_spans(keyed: DataFrame, window: int, gram: int, max_bits: int) -> DataFrame:
    """Row key and ``spans``: the words (start, stop) that an earlier document has, which may overlap; null if these are all of the text's."""
    docs = keyed.where(F.col("doc_id").isNotNull())

    def held(hashes: DataFrame, column: str) -> Bloom:
        return bloom_of(hashes, column, hashes.count(), max_bits=max_bits)

    known = held(cut(count_keys(docs, window, gram).where("n > 1").select("key")), "key")
    edges, rows_of = stored(edges_of(docs, known, window, gram), "edges")
    ids = edges.where("first < last")
    salted = lambda flag, x: F.when(F.col(flag), F.col("id").bitwiseXOR(F.lit(x)))
    ends = ids.select(F.explode(F.array(salted("joins", BEFORE), salted("forks", AFTER))).alias("h")).where("h is not null")
    by_key = edges.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    met, places = stored(paths_of(docs, held(ids, "id"), held(ends, "h"), held(by_key.where("n > 1 and first < last"), "key"), window, gram), "paths")
    drop_folder(docs.sparkSession, rows_of)
    digests = met.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    digests = cut(digests.select("d1", "d2", "first", "n"))
    later = spread_join(met, digests.drop("n"), ["d1", "d2"], hot_values(digests, "d1"), ["_k", "start"]).where("doc_id > first")
    by_row = later.groupBy("_k", "_t").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.max("total").alias("total"))  # as many as one text holds
    reach = F.aggregate("spans", F.lit(0), lambda a, s: F.when(s["start"] > a, a).otherwise(F.greatest(a, s["stop"])))
    out = cut(by_row.select("_k", "_t", F.when(reach < F.col("total"), F.col("spans")).alias("spans")))
    drop_folder(docs.sparkSession, places)
    return out


def remover(batch: pa.RecordBatch) -> dict:
    """What stays of each text; null spans are none."""
    out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept")}
    spans = batch.column("spans")
    flat, size = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy()
    start, stop = (flat.field(c).to_numpy() for c in ("start", "stop"))
    ends = np.cumsum(size)
    for data, b, n in zip(bytes_of(batch.column("text")), ends.tolist(), size.tolist(), strict=True):
        words = data.split()
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start[b - n : b], 1)
        np.add.at(depth, stop[b - n : b], -1)
        stays = np.cumsum(depth)[:-1] == 0
        kept = b" ".join(words if stays.all() else [words[i] for i in np.flatnonzero(stays).tolist()])
        for c, x in zip(out, (len(words), int(len(words) - stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
            out[c].append(x)
    return out


def counted(losing: Bloom, with_text: bool) -> Callable[[pa.RecordBatch], dict]:
    """Words and digest of a text that loses nothing, and the text itself if it may lose a part, or if it is asked for."""

    def kernel(batch: pa.RecordBatch) -> dict:
        needed = losing.has(batch.column("_k").to_numpy().view(np.uint64))
        texts = bytes_of(batch.column("text"))
        words = [x.split() for x in texts]
        return {
            "whole": [len(w) for w in words],
            "sha": [hashlib.sha256(b" ".join(w)).digest() for w in words],
            "kept_text": pa.array([x if n or with_text else None for x, n in zip(texts, needed.tolist(), strict=True)], pa.binary()).cast(pa.string()),
        }

    return kernel


def dedup_spans(docs: DataFrame, window: int = 13, gram: int = 4, max_bits: int = 1 << 26, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``; also ``kept``, the words that stay, with ``with_text``."""
    keyed = with_row_key(docs.select("doc_id", "text"))
    spans = repeated_spans(keyed, window, gram, max_bits)
    partial = spans.where("spans is not null")
    losing = bloom_of(partial, "_k", partial.count(), max_bits=max_bits)
    read = map_rows(keyed.select("doc_id", "_k", "_t", "text"), counted(losing, with_text), ["doc_id", "_k", "_t"], "whole long, sha binary, kept_text string")
    met = read.join(spans.withColumn("loses", F.lit(True)), ["_k", "_t"], "left")
    gone = F.col("loses").isNotNull() & F.col("spans").isNull()
    found = met.select("doc_id", "whole", "sha", gone.alias("gone"), F.when(~gone, F.col("kept_text")).alias("text"), "spans")

    def kernel(batch: pa.RecordBatch) -> dict:
        out = {"n_words": batch.column("whole").to_pylist(), "n_removed": [0] * batch.num_rows, "kept_sha256": [x.hex() for x in batch.column("sha").to_pylist()], "kept": [None] * batch.num_rows}
        for i in np.flatnonzero(batch.column("gone").to_numpy(zero_copy_only=False)).tolist():
            out["n_removed"][i], out["kept_sha256"][i], out["kept"][i] = out["n_words"][i], hashlib.sha256(b"").hexdigest(), ""
        texts = pa.compute.is_valid(batch.column("text"))
        made = remover(batch.filter(texts))
        for j, i in enumerate(np.flatnonzero(texts.to_numpy(zero_copy_only=False)).tolist()):
            for c in out:
                out[c][i] = made[c][j]
        return out if with_text else {c: x for c, x in out.items() if c != "kept"}

    return map_rows(found, kernel, ["doc_id"], "n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
