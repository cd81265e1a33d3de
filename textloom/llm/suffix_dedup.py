"""Removal of repeated byte strings by sparse, distributed suffix sorting.

Each byte that a string of ``length`` bytes covers goes if that string starts anywhere else, in
the same text or another. Texts are cut into segments whose windows can only equal windows of
segments with the same key (segments.py). Keys seen once are done. Of the rest, a segment whose
bytes occur twice repeats whole; where segments with one key differ, their windows' suffixes are
ordered by deep-shallow sorting (suffix_sort.py) in buckets of keys of bounded size, and
neighbours that share ``length`` bytes are repeats. A key with more than ``group_limit``
different segments is worked out exactly by counting 128-bit window digests instead, which
spreads one key over all tasks.

Keys travel to the texts in a Bloom filter of bounded size; what passes wrongly is only extra
rows, since counts are made again on what passed. Copies of segments are merged before any of
their bytes is shuffled.

Null or empty text: no bytes, nothing removed, the digest of the empty string. Texts shorter
than ``length`` stay as they are; very long ones are hashed in overlapping pieces. Repeated rows are repeats of each other. Null doc_ids are kept.
An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import bytes_of, cut, hot_values, map_rows, portions, spread_join, with_row_key
from .segments import SLICE, digests, segment_slice, slices
from .suffix_sort import repeated_windows

GRAM = 40
RANGES = "array<struct<a: int, b: int>>"
CONTENT = ["key", "c1", "c2"]
SALTS = 8


def segmented(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """For each slice of a batch: pieces of text, each one's row and offset in that row's text, and their segments.

    A very long text is taken in pieces that overlap by ``length`` - 1 bytes, so that each window is in one of them.
    """
    rows, offsets, pieces = [], [], []
    for i, x in enumerate(bytes_of(batch.column("text"))):
        for at in range(0, max(len(x) - length + 1, 1), SLICE):
            rows.append(i)
            offsets.append(at)
            pieces.append(x[at : at + SLICE + length - 1])
    row, offset = np.array(rows, np.int64), np.array(offsets, np.int64)
    for a, b in slices(pieces):
        yield pieces[a:b], row[a:b], offset[a:b], segment_slice(pieces[a:b], length, gram)


def count_keys(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, n) with the number of segments, or at least 2 if one could repeat within itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [(s[3], s[4]) for *_, s in segmented(batch, length, gram)]
            if found:
                keys, inner = (np.concatenate(x) for x in zip(*found, strict=True))
                u, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, weights=1 + inner).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"key": u.view(np.int64), "n": n})

    counted = docs.select("text").mapInArrow(run, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def shared_segments(docs: DataFrame, known: Bloom, length: int, gram: int) -> DataFrame:
    """Every segment whose key may be shared: row key, key, digest, start, runs, inner."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            k, t = (batch.column(c).to_numpy() for c in ("_k", "_t"))
            for texts, row, offset, (text, start, runs, key, inner) in segmented(batch, length, gram):
                hit = sent.value.has(key)
                text, start, runs, key, inner = (x[hit] for x in (text, start, runs, key, inner))
                if len(text):
                    c = digests(texts, text, start, runs, length)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "_k": k[row[text]], "_t": t[row[text]], "key": key.view(np.int64), "c1": c[:, 0], "c2": c[:, 1],
                            "start": (offset[text] + start).astype(np.int32), "runs": runs.astype(np.int32), "inner": inner,
                        }
                    )

    return docs.select("_k", "_t", "text").mapInArrow(
        run, "_k long, _t long, key long, c1 long, c2 long, start int, runs int, inner boolean"
    )


def segment_bytes(docs: DataFrame, wanted: Bloom, length: int, gram: int) -> DataFrame:
    """The bytes of the segments whose digest may be wanted, once for each batch."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for texts, _, _, (text, start, runs, key, _) in segmented(batch, length, gram):
                # The key passes first, which spares most digests.
                hit = np.flatnonzero(sent.value.has(key))
                c = digests(texts, text[hit], start[hit], runs[hit], length)
                rows: dict[str, list] = {n: [] for n in ("key", "c1", "c2", "bytes")}
                keys = key.view(np.int64)
                for i, c1, c2 in zip(hit.tolist(), c[:, 0].tolist(), c[:, 1].tolist(), strict=True):
                    if (c1, c2) not in seen:
                        seen.add((c1, c2))
                        at = int(start[i])
                        for n, v in zip(rows, (int(keys[i]), c1, c2, texts[text[i]][at : at + int(runs[i]) + length - 1]), strict=True):
                            rows[n].append(v)
                if rows["key"]:
                    yield pa.RecordBatch.from_pydict(rows)

    return docs.select("text").mapInArrow(run, "key long, c1 long, c2 long, bytes binary")


def sorted_ranges(contents: DataFrame, buckets: int, length: int) -> DataFrame:
    """Repeated window ranges of each content, by suffix sorting in buckets of whole keys."""
    schema = f"key long, c1 long, c2 long, ranges {RANGES}"

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("bytes").to_pylist()
        found = repeated_windows(texts, [len(x) - length + 1 for x in texts], length)
        ranges = pa.array([[{"a": a, "b": b} for a, b in x] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return table.select(CONTENT).append_column("ranges", ranges)

    dealt = contents.select(*CONTENT, "bytes", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(run, schema)


def counted_ranges(contents: DataFrame, length: int) -> DataFrame:
    """As sorted_ranges for keys of any size, by counting window digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = xxhash.xxh3_128_digest
        for batch in batches:
            for i, x in enumerate(batch.column("bytes").to_pylist()):
                n = len(x) - length + 1
                w = np.frombuffer(b"".join([d(x[j : j + length]) for j in range(n)]), np.int64).reshape(-1, 2)
                own = {c: np.full(n, batch.column(c)[i].as_py(), np.int64) for c in CONTENT}
                yield pa.RecordBatch.from_pydict(own | {"w1": w[:, 0], "w2": w[:, 1], "at": np.arange(n, dtype=np.int32)})

    windows = contents.select(*CONTENT, "bytes").mapInArrow(run, "key long, c1 long, c2 long, w1 long, w2 long, at int")
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    hits = windows.join(again, ["w1", "w2"], "left_semi").groupBy(*CONTENT).agg(F.collect_set("at").alias("at"))
    return hits.select(*CONTENT, F.transform("at", lambda i: F.struct(i.alias("a"), (i + 1).alias("b"))).cast(RANGES).alias("ranges"))


def repeated_spans(keyed: DataFrame, length: int, gram: int, group_limit: int, bucket_bytes: int) -> DataFrame:
    """Row key and ``spans``, the byte ranges (start, stop) that repeats cover; they may overlap."""
    keys = cut(count_keys(keyed, length, gram).where("n > 1").select("key"))
    occurrences = cut(shared_segments(keyed, bloom_of(keys, "key", keys.count()), length, gram))
    contents = cut(occurrences.groupBy(*CONTENT).agg(F.count("*").alias("n"), F.first("runs").alias("runs"), F.max("inner").alias("inner")))
    # Keys met by many different segments are common, so every key meets them in SALTS parts.
    mixed = contents.groupBy("key").agg(F.count("*").alias("m"), F.max("inner").alias("any")).where("m > 1 or any")
    parts = mixed.select("key", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    wanted = cut(contents.withColumn("_salt", F.pmod("c1", F.lit(SALTS)).cast("int")).join(parts, ["key", "_salt"]).drop("_salt"))
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.col("runs") + length).alias("bytes"), F.max("m").alias("m")).first()
    whole = contents.where("n > 1").select(*CONTENT, F.array(F.struct(F.lit(0).alias("a"), F.col("runs").alias("b"))).cast(RANGES).alias("ranges"))
    if size["n"]:
        held = segment_bytes(keyed, bloom_of(wanted.select("key").distinct(), "key", size["n"]), length, gram)
        held = held.join(wanted.select(*CONTENT, "n", "m"), CONTENT).groupBy(*CONTENT).agg(F.first("bytes").alias("bytes"), F.first("n").alias("n"), F.first("m").alias("m"))
        held = cut(held)
        buckets = max(1, -(-size["bytes"] // bucket_bytes))
        found = sorted_ranges(held.where(F.col("m") <= group_limit), buckets, length)
        if size["m"] > group_limit:
            found = found.unionByName(counted_ranges(held.where(F.col("m") > group_limit), length))
        once = contents.where("n = 1").select(*CONTENT)
        whole = whole.unionByName(found.where(F.size("ranges") > 0).join(once, CONTENT, "left_semi"))
    span = lambda r, start: F.struct((start + r["a"]).alias("start"), (start + r["b"] + length - 1).alias("stop"))
    # Rows alike in id and text give the same spans, which a set holds once.
    placed = spread_join(occurrences, whole, CONTENT[1:] + CONTENT[:1], hot_values(contents, "c1"), ["_k", "_t", "start"])
    placed = placed.select("_k", "_t", F.transform("ranges", lambda r: span(r, F.col("start"))).alias("spans"))
    return placed.groupBy("_k", "_t").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # as many as one text holds


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remover(with_text: bool) -> Callable[[pa.RecordBatch], dict]:
    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)}
        spans = batch.column("spans")
        flat, size = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy()
        start, stop = (flat.field(c).to_numpy() for c in ("start", "stop"))
        ends = np.cumsum(size)
        for data, b, n in zip(bytes_of(batch.column("text")), ends.tolist(), size.tolist(), strict=True):
            gone = merged(list(zip(start[b - n : b].tolist(), stop[b - n : b].tolist(), strict=True)))
            edges = [0, *(x for span in gone for x in span), len(data)]
            kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if gone else data
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(len(gone))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept)
        return out

    return kernel


def suffix_dedup(
    docs: DataFrame, length: int = 200, gram: int = GRAM, group_limit: int = 2000, bucket_bytes: int = 1 << 18, with_text: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``; also ``kept`` (binary) with ``with_text``."""
    keyed = with_row_key(docs.select("doc_id", "text"))
    joined = keyed.join(repeated_spans(keyed, length, gram, group_limit, bucket_bytes), ["_k", "_t"], "left")
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return map_rows(joined.select("doc_id", "text", "spans"), remover(with_text), ["doc_id"], added)
