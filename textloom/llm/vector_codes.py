"""Product codes of vectors by Hamerly's Lloyd iterations on whole numbers.

Each component x becomes floor(256 x), each vector ``parts`` equal consecutive parts, and each part position has a
codebook that starts as that part of the ``size`` smallest vec_ids. A round assigns every part to its nearest entry and
moves each entry to the floored mean of its parts. Between rounds a part keeps two persisted bounds: an upper one on the
distance to its entry, a lower one on the distance to the second nearest. They are widened by how far the entries
moved; only where the upper one isn't strictly below the lower one (or below half the way from its entry to the next) are all
entries scanned again, in whole numbers, so that ties always go to the lower index. Bounds are rounded outwards.

State goes from round to round as Parquet in the shared folder, of which the last generation alone is kept. Sums of
parts are made in the tasks: ``parts`` * ``size`` rows of whole numbers from each. The codebooks, ``size`` times a vector's
components however many vectors there are, are the only thing that passes through the driver.

Dropped: null vectors and those with null or non-finite components. Vectors shorter than the longest kept one (empty ones
too) are filled up with zeros, as is the longest up to a multiple of ``parts``. Components are held to +-2^27 after
scaling, so that sums stay exact. Null vec_ids come last in the order of starting entries; rows alike in vec_id start in the
order of their vectors, and repeated rows each count. Fewer than ``size`` vectors give as many entries. Null labels are
one label. An empty table gives an empty result. Columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_folder, hot_values, map_rows, portions, scratch_folder, spread_join

SCALE = 256
LARGEST = 1 << 27
#: Relative widening that covers the rounding of a few operations on doubles.
SLACK = 2.0**-48
PORTION = 1 << 18


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and ``v`` (array<int>) of the kept rows."""
    scaled = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = embeddings.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    return kept.select("vec_id", "label", F.transform("embedding", scaled).alias("v"))


def vectors_of(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Arrays of a list column as (rows, parts, width), filled up with zeros."""
    out = np.zeros((len(column), parts * width), np.int64)
    size = column.value_lengths().to_numpy()
    out[np.arange(parts * width) < size[:, None]] = column.flatten().to_numpy()
    return out.reshape(-1, parts, width)


def upward(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def downward(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) of one part position."""
    d = v[:, None, :] - book[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


def scan(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper and lower bound from all entries; ties go to the lower index."""
    d = squares(v, book)
    code = d.argmin(axis=1)
    rows = np.arange(len(v))
    least = d[rows, code]
    d[rows, code] = np.iinfo(np.int64).max
    second = d.min(axis=1).astype(np.float64) if book.shape[0] > 1 else np.full(len(v), np.inf)
    return code, upward(np.sqrt(least.astype(np.float64))), downward(np.sqrt(second))


class Moves:
    """How far the entries of each position moved, and half the way from each entry to the nearest other."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        gone = np.sqrt(((new - old) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLACK)
        self.own = gone
        order = np.sort(gone, axis=1)
        top, next_ = order[:, -1:], order[:, -2:-1] if gone.shape[1] > 1 else np.zeros_like(order)
        first = np.arange(gone.shape[1]) == gone.argmax(axis=1)[:, None]
        self.others = np.where(first, next_, top)
        self.half = np.full(gone.shape, np.inf)
        for p, book in enumerate(new if gone.shape[1] > 1 else []):
            d = squares(book, book)
            np.fill_diagonal(d, np.iinfo(np.int64).max)
            self.half[p] = np.sqrt(d.min(axis=1).astype(np.float64)) / 2 * (1 - SLACK)


def assigned(v: np.ndarray, books: np.ndarray, state: tuple[np.ndarray, ...] | None, moves: Moves | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds (rows, parts) against ``books``, and how many parts were scanned in full."""
    n, parts, _ = v.shape
    code, upper, lower = state or (np.zeros((n, parts), np.int64), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts), np.float32))
    code, upper, lower = code.astype(np.int64), upper.copy(), lower.copy()
    scanned = 0
    for p in range(parts):
        open_ = np.arange(n)
        if moves:
            c = code[:, p]
            upper[:, p] = upward(upper[:, p].astype(np.float64) + moves.own[p, c])
            low = lower[:, p].astype(np.float64)
            lower[:, p] = downward(np.maximum(low - moves.others[p, c], 0)) if books.shape[1] > 1 else np.inf
            bound = np.maximum(lower[:, p], moves.half[p, c])
            open_ = np.flatnonzero(~(upper[:, p] < bound))
            if len(open_):  # the exact distance to the own entry may do
                d = v[open_, p] - books[p, c[open_]]
                upper[open_, p] = upward(np.sqrt((d * d).sum(axis=1).astype(np.float64)))
                open_ = open_[~(upper[open_, p] < bound[open_])]
        if len(open_):
            code[open_, p], upper[open_, p], lower[open_, p] = scan(v[open_, p], books[p])
            scanned += len(open_)
    return code, upper, lower, scanned


def errors(v: np.ndarray, books: np.ndarray, code: np.ndarray) -> np.ndarray:
    d = v - books[np.arange(v.shape[1]), code]
    return (d * d).sum(axis=(1, 2))


def as_binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def from_binary(column: pa.Array, kind: type, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, parts)


def assign(state: DataFrame, books: np.ndarray, moves: Moves | None) -> DataFrame:
    """One assignment: vec_id, label, v, code, upper, lower, and the number of full scans of each row's batch in its first row."""
    sent = state.sparkSession.sparkContext.broadcast((books, moves))
    parts, _, width = books.shape

    def kernel(batch: pa.RecordBatch) -> dict:
        entries, moved = sent.value
        v = vectors_of(batch.column("v"), parts, width)
        held = None
        if moved:
            held = (from_binary(batch.column("code"), np.uint8, parts), *(from_binary(batch.column(c), np.float32, parts) for c in ("upper", "lower")))
        code, upper, lower, scanned = assigned(v, entries, held, moved)
        return {"code": as_binary(code.astype(np.uint8)), "upper": as_binary(upper), "lower": as_binary(lower), "scans": [scanned] + [0] * (batch.num_rows - 1)}

    source = state.select("vec_id", "label", "v", *["code", "upper", "lower"] * bool(moves))
    return map_rows(source, kernel, ["vec_id", "label", "v"], "code binary, upper binary, lower binary, scans long", PORTION)


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floored mean of its parts; unused ones stay."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        for whole in batches:
            for b in portions(iter([whole]), PORTION):
                v = vectors_of(b.column("v"), parts, width)
                at = from_binary(b.column("code"), np.uint8, parts).astype(np.int64) + np.arange(parts) * size
                np.add.at(sums, at.ravel(), v.reshape(-1, width))
                n += np.bincount(at.ravel(), minlength=parts * size)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_pydict({"slot": used.astype(np.int32), "n": n[used], "s": pa.array(list(sums[used]), pa.list_(pa.int64()))})

    found = state.select("v", "code").mapInArrow(run, "slot int, n long, s array<long>")
    each = found.select("slot", "n", F.posexplode("s").alias("i", "s")).groupBy("slot", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy().reshape(parts * size, width)
    for r in each.collect():  # at most one row for each component of each entry
        out[r["slot"], r["i"]] = r["s"] // r["n"]
    return out.reshape(books.shape)


def first_books(vectors: DataFrame, parts: int, size: int) -> np.ndarray | None:
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(-(-longest // parts), 1)
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).select("v").collect()
    v = vectors_of(pa.array([r["v"] for r in start], pa.list_(pa.int32())), parts, width)
    return np.ascontiguousarray(v.transpose(1, 0, 2))


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and label for each kept row of ``embeddings``; ``size`` is at most 256."""
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings)
    books = first_books(vectors, parts, size)
    if books is None:
        empty = vectors.where("false")
        return empty.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"), "label")
    state, moves, folders = vectors, None, []
    for _ in range(rounds):
        folders.append(scratch_folder(spark, "vector_codes"))
        assign(state, books, moves).write.mode("overwrite").parquet(folders[-1])
        state = spark.read.parquet(folders[-1])
        new = moved_books(state, books)
        books, moves = new, Moves(books, new)
        if len(folders) > 1:  # the generation before has been read for the last time
            drop_folder(spark, folders.pop(0))
    final = spark.sparkContext.broadcast(books)
    width = books.shape[2]

    def kernel(batch: pa.RecordBatch) -> dict:
        v = vectors_of(batch.column("v"), parts, width)
        code = from_binary(batch.column("code"), np.uint8, parts)
        return {"hex": [r.tobytes().hex() for r in np.ascontiguousarray(code)], "error": errors(v, final.value, code.astype(np.int64))}

    coded = cut(map_rows(assign(state, books, moves), kernel, ["vec_id", "label"], "hex string, error long", PORTION))
    for f in folders:
        drop_folder(spark, f)
    keyed = coded.withColumns({"_l": F.coalesce(F.col("label").cast("long"), F.lit(0)), "_none": F.col("label").isNull()})
    totals = keyed.groupBy("_l", "_none").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = spread_join(keyed, totals.drop("n"), ["_l", "_none"], hot_values(totals, "_l"), ["vec_id", "hex", "error"])
    return out.select("vec_id", F.col("hex").alias("code"), "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"), "label")
