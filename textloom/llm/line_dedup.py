"""Removal of repeated runs of lines.

A window is a least run of lines with ``min_lines`` lines and ``min_words`` words: one from each
line that has words onwards, one from each such line back, and every line of ``line_words`` words
by itself. Windows whose bytes occur earlier - in a document with a smaller id, or further up in
the same one - lose all their lines; the first occurrence stays. Any run of lines that is repeated
and long enough is covered by windows that lie within it, so that it goes whole, but for wordless
lines at its edges, wherever it stands and whatever surrounds it. A run that isn't made of whole
lines is not found. The earliest occurrence of a line's bytes is never removed.

A window is named by a rolling hash (a polynomial modulo 2 ** 64) over the hashes of its lines.
Names that occur twice travel to the texts in a Bloom filter of bounded size, so that only windows
that are (but for its errors) repeated are shuffled; these carry their bytes and are grouped and
joined by them, so that no collision of hashes removes a line. A name with over a thousandth of
all repeats (and 1,000 of them) is hot: its windows meet their first occurrence in ``SALTS``
parts. There are at most a thousand such names, so they travel as a list.

Null or empty text: no window, stays as it is. Null ids come first in the order. Rows alike in id
and text are one document: they keep or lose the same lines. Very long texts are taken whole. An
empty table gives an empty result. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import bytes_of, cut, map_rows, portions, with_row_key

SALTS = 64
#: Factor of the rolling hash, odd, and its inverse modulo 2 ** 64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Chunker:
    """Lines and windows of a text. Every window counts, so that ``divisor`` can only be 1; ``max_lines`` bounds windows, if given."""

    def __init__(self, min_lines: int = 2, min_words: int = 8, line_words: int = 50, divisor: int = 1, max_lines: int | None = None) -> None:
        if divisor != 1:
            raise ValueError("windows are not sampled: divisor must be 1")
        self.min_lines, self.min_words, self.line_words, self.max_lines = min_lines, min_words, line_words, max_lines

    def chunks(self, data: bytes) -> list[bytes]:
        """Lines with their line feeds; together they are the text."""
        lines = data.split(b"\n")
        return [x + b"\n" for x in lines[:-1]] + lines[-1:]

    def spans(self, data: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
        """Lines without their line feeds, and (first line, line after the last) of the windows, in order."""
        lines = data.split(b"\n")
        words = [len(x.split()) for x in lines]
        before = [0, *accumulate(words)]
        if before[-1] < min(self.min_words, self.line_words):
            return lines, []
        found = set()
        for i, n in enumerate(words):
            if n:
                end = max(i + self.min_lines, bisect_left(before, before[i] + self.min_words))
                start = min(i + 1 - self.min_lines, bisect_right(before, before[i + 1] - self.min_words) - 1)
                found |= {(i, end)} if end <= len(lines) else set()
                found |= {(start, i + 1)} if start >= 0 else set()
                found |= {(i, i + 1)} if n >= self.line_words else set()
        longest = self.max_lines or len(lines)
        return lines, [(a, b) for a, b in sorted(found) if b - a <= longest]

    def windows(self, data: bytes) -> list[tuple[int, int, bytes]]:
        """(first line, line after the last, bytes) of the windows; the last line feed is not part of one."""
        lines, spans = self.spans(data)
        return [(a, b, b"\n".join(lines[a:b])) for a, b in spans]

    def candidates(self, data: bytes) -> list[tuple[int, bytes]]:
        """(line, key): a line may go if one of its keys - its place in a window and the window's bytes - occurs earlier."""
        return [(i, b"%d " % (i - a) + x) for a, b, x in self.windows(data) for i in range(a, b)]


def powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling_hashes(lines: list[bytes], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of lines, the same wherever the run stands: differences of running sums over line hashes."""
    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(FACTOR, len(h)), dtype=np.uint64)])
    return ((sums[ends] - sums[starts]) * powers(INVERSE, len(h) + 1)[starts]).view(np.int64)


def named_windows(batch: pa.RecordBatch, chunker: Chunker) -> tuple[list[tuple[list[bytes], list[tuple[int, int]]]], np.ndarray]:
    """Lines and windows of each text, and the names of all windows in order."""
    found = [chunker.spans(x) for x in bytes_of(batch.column("text"))]
    found = [(lines if spans else [], spans) for lines, spans in found]
    before = np.cumsum([0, *(len(lines) for lines, _ in found)])
    at = np.array([(i + a, i + b) for i, (_, spans) in zip(before.tolist(), found) for a, b in spans], np.int64).reshape(-1, 2)
    return found, rolling_hashes([x for lines, _ in found for x in lines], at[:, 0], at[:, 1])


def name_counts(docs: DataFrame, chunker: Chunker) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            d, n = np.unique(named_windows(batch, chunker)[1], return_counts=True)
            yield pa.RecordBatch.from_pydict({"d": d, "n": n})

    return docs.select("text").mapInArrow(run, "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))


def nominated(keyed: DataFrame, known: Bloom, hot: np.ndarray, chunker: Chunker) -> DataFrame:
    """Row key, id, first line, line after the last, name and bytes of the windows that may be repeated, and whether they are hot."""
    sent = keyed.sparkSession.sparkContext.broadcast((known, hot))

    def kernel(batch: pa.RecordBatch) -> dict:
        found, d = named_windows(batch, chunker)
        repeats, often = sent.value
        flags = iter(zip(d.tolist(), repeats.has(d.view(np.uint64)).tolist(), np.isin(d, often).tolist(), strict=True))
        flagged = [(lines, [(a, b, *next(flags)) for a, b in spans]) for lines, spans in found]
        return {
            "windows": [
                [{"pos": a, "end": b, "d": d, "hot": h, "body": b"\n".join(lines[a:b])} for a, b, d, passed, h in own if passed]
                for lines, own in flagged
            ]
        }

    made = map_rows(keyed, kernel, ["doc_id", "_k", "_t"], "windows array<struct<pos: int, end: int, d: long, hot: boolean, body: binary>>")
    return made.select("doc_id", "_k", "_t", F.explode("windows").alias("w")).select("doc_id", "_k", "_t", "w.*")


def removed_windows(keyed: DataFrame, chunker: Chunker) -> DataFrame:
    """Row key and ``gone``, the windows (pos, end) to remove."""
    repeated = cut(name_counts(keyed, chunker).where("n > 1"))
    size = repeated.agg(F.count("*").alias("names"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    hot = repeated.where(F.col("n") > max(size["n"] // 1000, 1000)).select("d").toArrow()  # at most 1,000
    known = bloom_of(repeated, "d", size["names"])
    # The number only spreads rows that agree in all else.
    found = cut(nominated(keyed, known, hot.column("d").to_numpy(), chunker)).withColumn("salt", F.monotonically_increasing_id())
    place = F.struct("doc_id", "_k", "_t", "pos")
    kept = found.groupBy("d", "body").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("hot").alias("hot")).where("n > 1")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    kept = kept.select("d", "body", "first", F.explode(parts).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("salt"), F.lit(SALTS)).cast("int")).otherwise(0)
    later = found.withColumn("salt", salt).join(kept, ["d", "body", "salt"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("_k", "_t").agg(F.collect_set(F.struct("pos", "end")).alias("gone"))  # at most three for each line of one text


def dedup_lines(docs: DataFrame, chunker: Chunker | None = None) -> DataFrame:
    """``rest`` (a struct of all columns of ``docs`` as they were), the new ``text``, n_lines, n_removed_lines, n_removed_chunks (runs of them), kept_sha256."""
    chunker = chunker or Chunker()
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("rest"))
    keyed = with_row_key(packed)
    gone = removed_windows(keyed.select("doc_id", "text", "_k", "_t"), chunker)
    joined = keyed.join(gone, ["_k", "_t"], "left").select("rest", "gone")

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("text", "n_lines", "n_removed_lines", "n_removed_chunks", "kept_sha256")}
        column = batch.column("rest").field("text").cast(pa.large_binary()).to_pylist()
        for data, gone in zip(column, batch.column("gone").to_pylist(), strict=True):
            kept, drop = data, {i for w in gone or () for i in range(w["pos"], w["end"])}
            if drop:
                lines = chunker.chunks(data)
                kept = b"".join(x for i, x in enumerate(lines) if i not in drop)
                if len(lines) - 1 in drop:
                    kept = kept.removesuffix(b"\n")
            out["text"].append(None if kept is None else kept.decode())
            out["n_lines"].append(data.count(b"\n") + 1 if data else 0)
            out["n_removed_lines"].append(len(drop))
            out["n_removed_chunks"].append(sum(i - 1 not in drop for i in drop))
            out["kept_sha256"].append(hashlib.sha256(kept or b"").hexdigest())
        return out

    return map_rows(joined, kernel, ["rest"], "text string, n_lines long, n_removed_lines long, n_removed_chunks long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, chunker: Chunker | None = None) -> DataFrame:
    """``docs`` with repeated runs of lines taken out and n_chars, if there is one, set anew; documents left without a word go."""
    out = dedup_lines(docs, chunker)
    columns = []
    for c in docs.columns:
        value = F.col("rest")[c]
        if c == "text":
            value = F.col("text")
        elif c == "n_chars":
            value = F.when(F.col("n_removed_chunks") > 0, F.length("text")).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    emptied = (F.col("n_removed_chunks") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).select(*columns)
