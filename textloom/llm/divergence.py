"""How far the sources of each language differ in their terms, by wide term vectors.

Tasks count terms and emit a row for each language and term, which holds the counts of all sources seen there. Terms in
at least ``min_docs`` documents of their language are kept, each as one row whose counts are an array with a place for every
source of the language, in the order of their names. Higher-order functions on these arrays give the smoothed
shares and, for each place, the distances to all later places; both are summed in the tasks before a shuffle. What a
row holds grows with the number of sources of a language, never with their documents, and pairs are of sources only.

Shares are 1 + floor(10^9 (count + 5) / (N + 5 V)), divided digit by digit in base 1000, so that longs hold them exactly for
totals up to 9 * 10^15.

Null text, lang or source: ''. Texts without terms (empty ones too) make their group known, with counts of zero. A
very long text is counted in pieces. Repeated rows each count as a document. Ties in a report go to the lesser item in
the order of UTF-8 bytes. A language without kept terms has pairs of value 0 and no terms; one with a single source has
no pairs. An empty table gives an empty result. Columns other than text, lang and source are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, hot_values, portions, spread_join

#: Bytes of terms, A-Z lower-cased; a space for all others.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PIECE = 1 << 20
#: Distinct (language, source, term) that a task holds before it emits them.
HELD = 1 << 19
COUNTED = "lang string, term string, docs long, held array<struct<source: string, n: long>>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists from about PIECE bytes each."""
    plain = text.translate(TERM_BYTES)
    at = 0
    while at < len(plain):
        stop = plain.find(b" ", at + PIECE)
        stop = len(plain) if stop < 0 else stop
        yield plain[at:stop].split()
        at = stop


def emitted(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """One row for each language and term."""
    for lang in sorted({k[0] for k in counts}):
        own = [(source, n, d) for (x, source), (n, d) in counts.items() if x == lang and n]
        if not own:
            continue
        terms = pa.concat_arrays([pa.array(list(n), pa.binary()) for _, n, _ in own]).dictionary_encode()
        code = terms.indices.to_numpy()
        size = [len(n) for _, n, _ in own]
        n = np.concatenate([np.fromiter(n.values(), np.int64, len(n)) for _, n, _ in own])
        docs = np.concatenate([np.fromiter((d[t] for t in n), np.int64, len(n)) for _, n, d in own])
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
        source = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(own), dtype=np.int32), size)[order], [s for s, _, _ in own]).cast(pa.string())
        held = pa.ListArray.from_arrays(np.r_[first, len(order)].astype(np.int32), pa.StructArray.from_arrays([source, pa.array(n[order])], ["source", "n"]))
        names = terms.dictionary.cast(pa.string())
        rows = pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(first)), "term": names, "docs": np.add.reduceat(docs[order], first), "held": held})
        yield from (rows.slice(a, 1 << 14) for a in range(0, len(first), 1 << 14))


def count_terms(docs: DataFrame) -> DataFrame:
    """Counts of terms, one row for each language and term of a task (or of a part of it, if it meets very many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in portions(batches):
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), bytes_of(b.column("text")), strict=True):
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in terms_of(text):
                    n.update(terms)
                    own.update(terms)
                d.update(own)
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield from emitted(counts)
                counts = {}
        yield from emitted(counts)

    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return named.mapInArrow(run, COUNTED)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) for 0 < count <= total, exactly."""
    div = lambda a, b: F.call_function("div", a, b)
    q, r = div(count, total), count % total
    for _ in range(3):
        q, r = q * 1000 + div(r * 1000, total), (r * 1000) % total
    return q + 1


def term_vectors(docs: DataFrame, min_docs: int = 30, smoothing: int = 5, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, sources, terms, total) of each language, and (lang, term, sources, n, p, q) of each kept term.

    ``sources`` is an array of (source, total) in the order of names; ``n`` and ``p`` are arrays of counts and shares by
    source, ``q`` is the language's share.
    """
    counted = count_terms(docs).repartition("lang", "term")
    parts = counted.select("lang", "term", "docs", F.posexplode("held").alias("_i", "h"))
    by_source = parts.groupBy("lang", "term", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("n"), F.sum(F.when(F.col("_i") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("held"))
    kept = cut(by_term.where(F.col("docs") >= min_docs).drop("docs"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("total")))).alias("sources"))
    langs = langs.join(number, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    langs = cut(langs.withColumn("total", F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["total"])))
    # Few languages hold all terms, so every language meets its terms in parts.
    wide = spread_join(kept, langs, ["lang"], hot_values(number.withColumnRenamed("terms", "n"), "lang"), ["term"], salts)
    number_of = lambda s: F.coalesce(F.col("held")[s["source"]], F.lit(0).cast("long"))
    all_of = lambda total: total + smoothing * F.col("terms")
    wide = wide.withColumn("n", F.transform("sources", number_of))
    wide = wide.withColumn("p", F.zip_with("n", "sources", lambda n, s: share(n + smoothing, all_of(s["total"]))))
    q = share(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n) + smoothing, all_of(F.col("total")))
    return langs, wide.select("lang", "term", "sources", "n", "p", q.alias("q"))


def source_distances(langs: DataFrame, wide: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of different sources of a language."""
    first = wide.select("lang", "p", F.posexplode("p").alias("i", "own"))
    later = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.col("own")))
    sums = first.select("lang", "i", F.posexplode(later).alias("k", "f")).groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum("f").alias("value"))
    named = langs.select("lang", F.col("sources.source").alias("s"))
    left = named.select("lang", "s", F.posexplode("s").alias("i", "source"))
    pairs = left.select("lang", "i", "source", F.posexplode("s").alias("j", "item")).where("i <> j")
    both = sums.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("at"), "value").select("lang", "at.*", "value")
    return pairs.join(both, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 30, smoothing: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the ``top`` terms a source has more of than its language."""
    langs, wide = term_vectors(docs, min_docs, smoothing)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_distances(langs, wide).withColumn("rank", F.row_number().over(order))
    each = wide.select("lang", F.col("term").alias("item"), "q", F.explode(F.arrays_zip(F.col("sources.source").alias("source"), "n", "p")).alias("x"))
    more = each.where("x.n > 0 and x.p > q").select("lang", "x.source", "item", (F.col("x.p") - F.col("q")).alias("value"))
    terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
