"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Items are cut into pieces of ``piece`` bytes that start every quarter of that (a shorter item is
one piece), so that an excerpt of 5/4 * piece - 1 bytes has a whole piece in it. A text
holds a piece if some stretch of it is within k = rate * length edits. By the q-gram lemma such a
stretch shares at least length - q + 1 - k * q grams with the piece, on diagonals at most k
apart. Texts are scanned once: shared grams are counted per text and piece, then per band of
diagonals; bands are 2k wide and overlap by half, so that one of them has all grams of a match.
Runs of bands that reach the bound are verified by banded alignment, which gives the edits.

Comparison is on text with A-Z lower-cased and blanks collapsed. The benchmark is taken in
blocks of at most ``block_bytes``, PASS blocks in each stage, and every block meets all texts, so
what is broadcast is bounded however large the benchmark is. Very long texts are taken in
overlapping stretches, and shared grams some ENTRIES at a time, so that memory doesn't follow
the text or how often a gram repeats.

Null or empty texts and items match nothing. An item under ``least`` bytes counts where it stands
exactly and between word boundaries; one under Q bytes is no evidence, see ``too_short``. Null
ids pass through. Repeated rows are reported each; of several matches of an item in a text the
one with the fewest edits, then the smallest start, counts. Empty tables give an empty result (or,
filtering, all texts). Columns other than doc_id, text and item_id, text are ignored; the filter
keeps all columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bytes_of, cut, portions
from .suffix_sort import words_at

Q = 8
#: Bytes of text scanned at once, and log2 of the slots of the table that sieves grams.
SLICE = 1 << 20
SIEVE = 20
#: Shared grams worked on at once, diagonals aligned at once, and blocks of the benchmark in a stage.
ENTRIES = 1 << 20
MERGED = 1 << 14
PASS = 4
#: A fixed value: an odd factor that spreads a gram's bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(data: bytes) -> bytes:
    return b" ".join(data.lower().split())


@dataclass(frozen=True)
class GramIndex:
    """Distinct pieces with the items that hold them, and where their grams stand; ``first`` has the bounds of each gram's entries."""

    items: list[list]
    pieces: list[bytes]
    edits: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    piece_of: np.ndarray
    place_of: np.ndarray
    sieve: np.ndarray


def slot(grams: np.ndarray) -> np.ndarray:
    return (grams * SPREAD) >> np.uint64(64 - SIEVE)


def build_index(items: list[tuple], rate: float, piece: int, least: int) -> GramIndex:
    """Items of ``least`` bytes and more in pieces every ``piece`` / 4 bytes; shorter ones are a piece without edits."""
    holders: dict[bytes, list] = {}
    for item, text in items:
        data = normal(text)
        if len(data) < Q:
            continue
        starts = list(range(0, max(len(data) - piece, 0) + 1, max(piece // 4, 1)))
        if starts[-1] + piece < len(data):
            starts.append(len(data) - piece)
        for a in starts:
            own = holders.setdefault(data[a : a + piece], [])
            if item not in own:
                own.append(item)
    pieces = list(holders)
    sizes = np.array([len(x) for x in pieces], np.int64)
    edits = np.where(sizes < max(least, 2 * Q), 0, np.minimum((rate * sizes).astype(np.int64), (sizes - Q) // Q))
    grams = [words_at(np.frombuffer(x, np.uint8))[: len(x) - Q + 1] for x in pieces]
    flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    count = sizes - Q + 1
    order = np.argsort(flat, kind="stable")
    distinct, first = np.unique(flat[order], return_index=True)
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[slot(distinct)] = True
    where = np.repeat(np.arange(len(pieces), dtype=np.int32), count)[order]
    place = (np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)[order]
    return GramIndex(list(holders.values()), pieces, edits, count - edits * Q, distinct, np.append(first, len(flat)), where, place, sieve)


def known_grams(index: GramIndex, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose gram stands in a piece, and the numbers of those grams."""
    grams = words_at(data)
    at = np.flatnonzero(index.sieve[slot(grams)])
    found = np.searchsorted(index.grams, grams[at])
    found[found == len(index.grams)] = 0
    real = index.grams[found] == grams[at]
    return at[real], found[real]


def expanded(index: GramIndex, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which of the found grams, piece, place in the piece) of every shared gram, some ENTRIES at a time."""
    n = index.first[found + 1] - index.first[found]
    ends = np.cumsum(n)
    a = 0
    while a < len(found):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ENTRIES, "right")), a + 1)
        m = n[a:b]
        entry = np.repeat(index.first[found[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        yield np.repeat(np.arange(a, b), m), index.piece_of[entry].astype(np.int64), index.place_of[entry].astype(np.int64)
        a = b


def sorted_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return x[first], np.diff(first, append=len(x))


def distinct_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, back = np.unique(keys, return_inverse=True)
    return u, np.bincount(back, weights=counts, minlength=len(u)).astype(np.int64)


def bands_of(index: GramIndex, text: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Rows (text, piece, lowest diagonal) of the bands that reach the piece's bound, from known grams: text, position in it, number.

    Grams are counted per text and piece first; pairs that reach the bound are then counted per
    band, each place of the piece once, so that a gram that stands everywhere enters a band once.
    """
    n = len(index.pieces)
    counts = [sorted_runs(text[i] * n + piece) for i, piece, _ in expanded(index, found)]
    if not counts:
        return np.empty((0, 3), np.int64)
    owner, count = distinct_counts(counts)
    good = owner[count >= index.bounds[owner % n]]
    most = max(len(x) for x in index.pieces)
    span = int(at.max()) + 2 * most + 4
    rows: list[np.ndarray] = [np.empty(0, np.int64)]
    for i, piece, place in expanded(index, found):
        own = text[i] * n + piece
        slot_ = np.minimum(np.searchsorted(good, own), max(len(good) - 1, 0))
        hit = good[slot_] == own if len(good) else np.zeros(len(own), bool)
        i, piece, place, slot_ = i[hit], piece[hit], place[hit], slot_[hit]
        band = (at[i] - place + most) // np.maximum(index.edits[piece], 1) + 1
        # A gram is in its own band and in the one below.
        packed = (np.concatenate((slot_ * span + band, slot_ * span + band - 1)) * most) + np.tile(place, 2)
        rows.append(sorted_runs(packed)[0])
    keys, count = sorted_runs(sorted_runs(np.concatenate(rows))[0] // most)
    own, band = good[keys // span] if len(keys) else keys, keys % span - 1
    piece = own % n
    reach = count >= index.bounds[piece]
    low = band * np.maximum(index.edits[piece], 1) - most
    return np.stack((own // n, piece, low), axis=1)[reach]


def candidates(index: GramIndex, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(text, piece, lowest diagonal, highest) of the runs of bands that reach the piece's bound, in order."""
    data = np.frombuffer((b"\0" * Q).join(texts) + b"\0" * Q, np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(x) + Q for x in texts])))[:-1]
    at, found = known_grams(index, data)
    text = np.searchsorted(starts, at, "right") - 1
    at = at - starts[text]
    size = np.cumsum(index.first[found + 1] - index.first[found])
    a = 0
    while a < len(at):  # whole texts with some ENTRIES together, one at least
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + ENTRIES, "right"))
        b = int(np.searchsorted(text, text[min(b, len(at) - 1)])) if b < len(at) else b
        b = max(b, int(np.searchsorted(text, text[a], "right")))
        run: list[int] = []
        for t, p, d in bands_of(index, text[a:b], at[a:b], found[a:b]).tolist():
            k = max(int(index.edits[p]), 1)
            if run and run[:2] == [t, p] and d - k <= run[3] and d - run[2] < MERGED:
                run[3] = d + 3 * k
                continue
            if run:
                yield tuple(run)
            run = [t, p, d - k, d + 3 * k]
        if run:
            yield tuple(run)
        a = b


def banded_edits(piece: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The fewest edits from ``piece`` to a stretch of ``text`` on diagonals low..high, with its start and stop."""
    m, width = len(piece), high - low + 1
    same = text.find(piece, max(low, 0), max(high + m, 0))
    if same >= 0:  # a diagonal without edits
        return 0, same, same + m
    p, t = np.frombuffer(piece, np.uint8), np.frombuffer(text, np.uint8)
    padded = np.zeros(width + m + 1, np.uint8)  # text from position low on; 0 matches nothing
    a, b = max(low, 0), min(low + len(padded), len(t))
    if a < b:
        padded[a - low : b - low] = t[a:b]
    far = most + 1
    pos = np.arange(low, high + 1)
    cost = np.where((pos >= 0) & (pos <= len(t)), 0, far)
    begin = pos.copy()
    step = np.arange(width)
    skip, from_ = np.full(width, far + 1), np.zeros(width, np.int64)
    for i in range(m):
        take = cost + (padded[i : i + width] != p[i])
        skip[:-1] = cost[1:] + 1
        from_[:-1] = begin[1:]
        down = skip < take
        cost = np.where(down, skip, take)
        begin = np.where(down, from_, begin)
        shifted = cost - step  # then characters of the text that the piece lacks
        best = np.minimum.accumulate(shifted)
        better = best < shifted
        if better.any():
            cost, begin = best + step, begin[np.maximum.accumulate(np.where(better, 0, step))]
        if cost.min() >= far:
            return None
    end = pos + m
    cost = np.where((end >= 0) & (end <= len(t)), cost, far)
    i = int(cost.argmin())
    return (int(cost[i]), int(begin[i]), int(end[i])) if cost[i] <= most else None


def stretches(texts: list[bytes], reach: int) -> list[tuple[int, int, bytes]]:
    """(text, offset, bytes): texts of over SLICE bytes in stretches that overlap by ``reach``, the others whole."""
    return [(i, a, x[a : a + SLICE + reach]) for i, x in enumerate(texts) for a in range(0, max(len(x) - reach, 1), SLICE)]


def whole_words(text: bytes, start: int, stop: int) -> bool:
    """Whether blanks or the text's ends stand around a stretch of a normalised text."""
    return (start == 0 or text[start - 1] == 32) and (stop == len(text) or text[stop] == 32)


def matches(index: GramIndex, texts: list[bytes], least: int = 24) -> dict[int, dict]:
    """For each text that holds a piece: item to (edits, start, stop) of its best match."""
    found: dict[int, dict] = {}
    if not index.pieces:
        return found
    plain = [normal(x) for x in texts]
    parts = stretches(plain, 2 * (max(map(len, index.pieces)) + 2 * max(int(index.edits.max()), 1)))
    start, held = 0, 0
    for i, (_, _, x) in enumerate(parts):
        held += len(x) + Q
        if held < SLICE and i + 1 < len(parts):
            continue
        for d, p, low, high in candidates(index, [x for _, _, x in parts[start : i + 1]]):
            text, offset, part = parts[start + d]
            if len(index.pieces[p]) < least:
                got = exact_words(index.pieces[p], plain[text], max(low, 0) + offset, high + offset)
            else:
                got = banded_edits(index.pieces[p], part, low, high, int(index.edits[p]))
                got = got and (got[0], got[1] + offset, got[2] + offset)
            if got:
                own = found.setdefault(text, {})
                for item in index.items[p]:
                    own[item] = min(own.get(item, got), got)
        start, held = i + 1, 0
    return found


def exact_words(piece: bytes, text: bytes, low: int, high: int) -> tuple[int, int, int] | None:
    """The first place from low to high where ``piece`` stands between word boundaries."""
    at = text.find(piece, low, high + len(piece))
    while at >= 0 and not whole_words(text, at, at + len(piece)):
        at = text.find(piece, at + 1, high + len(piece))
    return (0, at, at + len(piece)) if at >= 0 else None


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's items, a bounded block at a time on the driver."""
    part, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        part.append((r["item_id"], r["text"].encode()))
        held += len(part[-1][1])
        if held >= block_bytes:
            yield part
            part, held = [], 0
    if part:
        yield part


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, piece: int = 120, least: int = 24, block_bytes: int = 1 << 20
) -> DataFrame:
    """One row per text and item found in it: doc_id, item_id, edits, start, stop (bytes of the normalised text)."""
    schema = T.StructType(
        [docs.schema["doc_id"], benchmark.schema["item_id"], *T.StructType.fromDDL("edits int, start int, stop int").fields]
    )
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch], indexes: list[GramIndex]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            texts = bytes_of(b.column("text"))
            rows = [(d, item, *got) for index in indexes for d, own in matches(index, texts, least).items() for item, got in own.items()]
            if rows:
                d, *rest = zip(*rows, strict=True)
                arrays = [b.column("doc_id").take(pa.array(d, pa.int64())), *(pa.array(x, f.type) for x, f in zip(rest, list(target)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=target.names)

    out = None
    for group in batched(blocks(benchmark, block_bytes), PASS):
        sent = [docs.sparkSession.sparkContext.broadcast(build_index(part, rate, piece, least)) for part in group]
        leaks = docs.select("doc_id", "text").mapInArrow(lambda batches, sent=sent: run(batches, [x.value for x in sent]), schema)
        out = leaks if out is None else out.unionByName(leaks)
        out = cut(out) if len(group) == PASS else out
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, piece: int = 120, least: int = 24, block_bytes: int = 1 << 20
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item."""

    def run(batches: Iterator[pa.RecordBatch], indexes: list[GramIndex]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            for index in indexes:
                found = matches(index, bytes_of(b.column("text")), least)
                b = b.filter(pa.array([i not in found for i in range(b.num_rows)], pa.bool_()))
            yield b

    for group in batched(blocks(benchmark, block_bytes), PASS):
        sent = [docs.sparkSession.sparkContext.broadcast(build_index(part, rate, piece, least)) for part in group]
        kept = docs.mapInArrow(lambda batches, sent=sent: run(batches, [x.value for x in sent]), docs.schema)
        docs = cut(kept) if len(group) == PASS else kept
    return docs


def leaks_per_item(leaks: DataFrame) -> DataFrame:
    """How many texts hold each item, and the fewest edits: a report on the benchmark."""
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("edits").alias("fewest_edits"))


def too_short(benchmark: DataFrame) -> DataFrame:
    """The items that are no evidence: those under Q bytes when normalised."""
    normalised = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return benchmark.where(F.coalesce(F.octet_length(normalised), F.lit(0)) < Q)
