"""Page attribution by shared character n-grams.

Texts are compared in Arrow batches, a document's pages and chunks in one row; a document that is too long for a task is
dealt out in rows of a block of its pages and a part of its chunks each, whose best pages are compared afterwards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written

#: A fixed value: an odd factor that spreads the bits of a hash.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Occurrences of grams that are counted without asking for rare ones first.
FEW = 1 << 14
#: Characters whose grams are hashed at once.
HASHED = 1 << 20
MARK = re.compile("[，。！？；：、]")
PUNCTUATION = re.compile(r"\s*([，。！？；：、])\s*")


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) of the pages that aren't blank."""
    return pages.where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")).select("doc_id", "page_no", "text")


def page_normal(text: str) -> str:
    """Text as page matching compares it: single blanks, none around CJK punctuation, no soft hyphens."""
    kept = " ".join(text.split()).replace("\0", "").replace("\xad", "")
    return (kept if kept.isascii() or not MARK.search(kept) else PUNCTUATION.sub(r"\1", kept)).strip()


def anchors(content: str, title: str | None) -> Iterator[str]:
    """Up to three texts to look for: the first prose lines, middle ones, the title with the content."""
    lines = (x.strip() for x in content.split("\n"))
    prose = [x for x in lines if x and not x.startswith(("|", "#", "- "))]
    if prose:
        yield page_normal(" ".join(prose[:3]))
    if len(prose) > 6:
        yield page_normal(" ".join(prose[len(prose) // 2 :][:3]))
    if title:
        yield page_normal(f"{title} {content}")


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted set of each text's ``n``-character substrings without blanks, as 64-bit hashes; none for a shorter text."""
    bare = ["".join(t.split()) for t in texts]
    points = np.frombuffer(("".join(bare) + "\0" * n).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    ends = np.cumsum(sizes)
    starts, lasts = ends - sizes, ends - np.minimum(sizes, n - 1)
    h = np.zeros(len(points) - n, np.uint64)
    for i in range(n):
        h = (h ^ points[i : i + len(h)]) * SPREAD
        h ^= h >> np.uint64(29)
    for a, b in zip(starts.tolist(), lasts.tolist(), strict=True):
        h[a:b].sort()
    kept = np.concatenate((h[:1] == h[:1], h[1:] != h[:-1]))
    kept[starts[starts < lasts]] = True
    for i in range(1, n):  # grams that reach into the next text
        kept[(ends - i)[sizes >= i]] = False
    flat, after = h[kept], np.concatenate(([0], np.cumsum(kept)))
    return [flat[a:b] for a, b in zip(after[starts].tolist(), after[ends].tolist(), strict=True)]


def many_gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """``gram_sets`` of any number of texts, some at once."""
    out: list[np.ndarray] = []
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > HASHED:
            out += gram_sets(held, n)
            held, size = [], 0
    return out + gram_sets(held, n) if held else out


class PageIndex:
    """An inverted index of the grams of some pages, in order."""

    def __init__(self, numbers: list[int], sets: list[np.ndarray]) -> None:
        self.numbers, self.sets = numbers, sets
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(flat)
        flat = flat[order]
        first = np.flatnonzero(np.concatenate((flat[:1] == flat[:1], flat[1:] != flat[:-1])))
        self.grams, self.first = flat[first], np.append(first, len(flat))
        self.page = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]

    def counted(self, at: np.ndarray) -> np.ndarray:
        """How many of some grams of the index each page has."""
        low = self.first[at]
        size = self.first[at + 1] - low
        places = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.page[places], minlength=len(self.sets))

    def best(self, grams: np.ndarray, need: int) -> tuple[int, int] | None:
        """How many grams the page with most of them has, and the first such page, if these are enough.

        Where grams are on many pages, rare ones are asked first. A page with ``low`` of the ``p`` grams that are on any page
        has one of any ``p - low + 1``, so that as soon as a page with ``low`` is known few others can be better.
        """
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        at = at[self.grams[at] == grams] if len(self.grams) else at[:0]
        p = len(at)
        if p < need:
            return None
        often = self.first[at + 1] - self.first[at]
        total = int(often.sum())
        if total > FEW:
            order = np.argsort(often, kind="stable")
            at, seen = at[order], np.cumsum(often[order])
            k = max(int(np.searchsorted(seen, FEW // 8, "right")), 1)
            c = self.counted(at[:k])
            page = int(c.argmax())
            hits = shared(grams, self.sets[page])
            low = max(hits, need)
            if p - low + 1 > k:
                k = p - low + 1
                c = self.counted(at[:k])
            rivals = np.flatnonzero(c >= max(low - (p - k), 1))
            if len(rivals) * 1000 < total:  # else counting all costs less than looking at so many
                for i in rivals[np.argsort(-c[rivals], kind="stable")].tolist():
                    if c[i] + p - k < hits:
                        break
                    own = shared(grams, self.sets[i])
                    if own > hits or (own == hits and i < page):
                        hits, page = own, i
                return (hits, page) if hits >= need else None
        c = self.counted(at)
        page = int(c.argmax())
        return (int(c[page]), page) if c[page] >= need else None


def shared(few: np.ndarray, grams: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if not len(grams):
        return 0
    at = np.minimum(np.searchsorted(grams, few), len(grams) - 1)
    return int(np.count_nonzero(grams[at] == few))


def found_pages(
    chunks: list[tuple[str | None, str | None]], pages: list[tuple[int, str, bool]], total: int, n: int, per_cent: int, reach: int, tail_per_cent: int, every: bool = False
) -> Iterator[tuple[int, int, int, int, int]]:
    """(chunk's place, anchor, hits, page_start, page_end) for the first anchor of a chunk that a page matches; with ``every`` for all such.

    ``chunks`` are contents and titles. A page that isn't marked is none to start at. ``total`` is the number of the document's pages.
    """
    pages = sorted(pages)
    sets = many_gram_sets([page_normal(t) for _, t, _ in pages], n)
    own = [i for i, (_, _, home) in enumerate(pages) if home]
    index = PageIndex([pages[i][0] for i in own], [sets[i] for i in own])
    where = {no: x for (no, _, _), x in zip(pages, sets, strict=True)}
    for at in range(0, len(chunks), 256):
        part = [(content or "", title) for content, title in chunks[at : at + 256]]
        firsts = [next(anchors(*c), "") for c in part]
        tails = [page_normal(content)[-150:] if reach else "" for content, _ in part]
        hashed = many_gram_sets(firsts + tails, n)
        for i, c in enumerate(part):
            ends = None
            for a, text in enumerate(anchors(*c)):
                if len(text) < 20:
                    continue
                grams = hashed[i] if a == 0 else gram_sets([text], n)[0]
                if len(grams) < 4:
                    continue
                best = index.best(grams, max(-(-len(grams) * per_cent // 100), 1))
                if best is None:
                    continue
                start = index.numbers[best[1]]
                if ends is None:
                    tail = hashed[len(part) + i]
                    ends = tail if len(tails[i]) >= 40 and len(tail) >= 5 else tail[:0]
                end = start
                while len(ends) and end < min(start + reach, total) and end + 1 in where and shared(ends, where[end + 1]) * 100 >= len(ends) * tail_per_cent:
                    end += 1
                yield at + i, a, best[0], start, end
                if not every:
                    break


def blocks_of(texts: DataFrame, chunks: DataFrame, block_chars: int) -> DataFrame:
    """(doc_id, total, lows, parts) of documents with over ``block_chars`` of pages or chunks: where blocks of pages start, and the number of parts of the chunks."""
    by_page = texts.groupBy("doc_id", "page_no").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("k"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("page_no")) - F.col("n")  # a small row for each page
    starts = by_page.withColumn("b", F.floor(before / block_chars)).groupBy("doc_id", "b").agg(F.min("page_no").alias("low"), F.sum("k").alias("k"))
    lows = starts.groupBy("doc_id").agg(F.sum("k").alias("total"), F.array_sort(F.collect_list("low")).alias("lows"))
    size = chunks.groupBy("doc_id").agg(F.sum(F.length("content")).alias("n"))
    parts = F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / (2 * block_chars)), F.lit(1)).cast("int")
    return lows.join(size, "doc_id").select("doc_id", "total", "lows", parts.alias("parts")).where("parts > 1 or size(lows) > 1")


def page_ranges(
    chunks: DataFrame,
    pages: DataFrame,
    n: int = 5,
    per_cent: int = 25,
    reach: int = 3,
    tail_per_cent: int = 20,
    task_chars: int = 1 << 22,
    block_chars: int = 1 << 22,
) -> DataFrame:
    """(doc_id, chunk, page_start, page_end) of the chunks that a page matches.

    ``chunks`` has doc_id, chunk, content and section_title. The first anchor that shares ``per_cent``
    of its grams with a page decides; of equal pages the first wins. Up to ``reach`` more pages
    follow while each shares enough of the chunk's tail. A document's pages and chunks meet in one
    row and are compared there, so that a chunk and a page are moved once each, and not their grams.
    One with over ``task_chars`` characters of pages and chunks is dealt out: each block of ``block_chars`` of its pages
    (and the ``reach`` pages after it) meets each part of twice as much of its chunks in a row, and of the pages that
    blocks find for a chunk the best one is taken.

    Null ids match nothing. Repeated chunk numbers are matched each. A null or empty content has no
    anchor but the title with it. Other columns are ignored.
    """
    asked = chunks.select("doc_id", "chunk", "content", "section_title").where("doc_id is not null")
    texts = page_texts(pages).where("doc_id is not null")
    schema = T.StructType([asked.schema["doc_id"], asked.schema["chunk"], *T.StructType.fromDDL("page_start int, page_end int").fields])
    merging = T.StructType([*schema.fields, *T.StructType.fromDDL("same long, copy int, a int, hits long").fields])

    def compared(rows: DataFrame, every: bool) -> DataFrame:
        target = to_arrow_schema(merging if every else schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):  # ``total`` is null where the row holds all pages of its document
                    doc, total = (batch.column(c)[i].as_py() for c in ("doc_id", "total"))
                    own, text = (batch.column(c)[i].values for c in ("chunks", "pages"))
                    content, title = (own.field(c).to_pylist() for c in ("content", "section_title"))
                    held = list(zip(*(text.field(c).to_pylist() for c in ("page_no", "text", "home")), strict=True))
                    found = list(found_pages(list(zip(content, title, strict=True)), held, len(held) if total is None else total, n, per_cent, reach, tail_per_cent, every and total is not None))
                    place, a, hits, start, end = zip(*found, strict=True) if found else [()] * 5
                    columns = [[doc] * len(place), own.field("chunk").take(pa.array(place, pa.int64())), start, end]
                    if every:
                        number: Counter = Counter()
                        named = list(zip(own.field("chunk").to_pylist(), same := own.field("same").to_pylist(), strict=True))
                        copies = [number.update([x]) or number[x] for x in named]
                        columns += [[same[x] for x in place], [copies[x] for x in place], a, hits]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, (list, tuple)) else x for x, f in zip(columns, target, strict=True)], names=target.names)

        return rows.select("doc_id", "chunks", "pages", "total").mapInArrow(run, merging if every else schema)

    def in_one_row(asked: DataFrame, texts: DataFrame) -> DataFrame:
        held = asked.groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "content", "section_title")).alias("chunks"))  # a document's
        held_pages = texts.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", "text", F.lit(True).alias("home"))).alias("pages"))
        return compared(held.join(held_pages, "doc_id").withColumn("total", F.lit(None).cast("long")), every=False)

    def dealt(asked: DataFrame, texts: DataFrame) -> DataFrame:
        blocks = written(blocks_of(texts, asked, block_chars), "blocks")
        keys = ["doc_id", "part", "block"]
        upto = lambda c: F.sequence(F.lit(0), F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) - 1)
        # The block whose pages begin last at or before a number; a document without blocks is one.
        holding = lambda no: F.coalesce(F.greatest(F.size(F.filter("lows", lambda x: x <= no)) - 1, F.lit(0)), F.lit(0))
        same = F.xxhash64("content", F.lit(0), "section_title")
        number = F.pmod(F.xxhash64("chunk", "same"), F.coalesce("parts", F.lit(1))).cast("int")
        asking = asked.withColumn("same", same).join(blocks, "doc_id", "left").withColumn("part", number).withColumn("block", F.explode(upto(F.size("lows"))))
        placed = texts.join(blocks, "doc_id", "left").withColumn("own", holding(F.col("page_no"))).withColumn("part", F.explode(upto("parts")))
        near = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda j: holding(F.col("page_no") - j)))
        placed = placed.withColumn("block", F.explode(F.when(F.col("lows").isNull(), F.array(F.lit(0))).otherwise(near)))
        tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few large rows aren't put into one task
        held = asking.repartition(tasks, *keys).groupBy(keys).agg(F.collect_list(F.struct("chunk", "content", "section_title", "same")).alias("chunks"))
        page = F.struct("page_no", "text", (F.col("own") == F.col("block")).alias("home"))
        held_pages = placed.repartition(tasks, *keys).groupBy(keys).agg(F.collect_list(page).alias("pages"), F.first("total").alias("total"))
        found = compared(held.join(held_pages, keys), every=True)
        first = F.min_by(F.struct("page_start", "page_end"), F.struct("a", -F.col("hits"), "page_start"))
        return found.groupBy("doc_id", "chunk", "same", "copy").agg(first.alias("p")).select("doc_id", "chunk", "p.page_start", "p.page_end")

    if task_chars <= 0:
        return dealt(asked, texts)
    sizes = pages.select("doc_id", F.length("text").alias("n")).unionByName(chunks.select("doc_id", F.length("content").alias("n")))
    large = written(sizes.groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") > task_chars).select("doc_id"), "large")
    if large.isEmpty():
        return in_one_row(asked, texts)
    of_large = dealt(*(x.join(large, "doc_id", "left_semi") for x in (asked, texts)))
    return in_one_row(*(x.join(large, "doc_id", "left_anti") for x in (asked, texts))).unionByName(of_large)


def match_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, chunk, page_start): the best page of each chunk that has one."""
    return page_ranges(chunks, pages, reach=0).drop("page_end")


def attribute_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunks`` with page_start and page_end, null where no page matches."""
    ranged = page_ranges(chunks, pages)
    return chunks.drop("page_start", "page_end").join(ranged, ["doc_id", "chunk"], "left")
