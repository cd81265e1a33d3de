"""Sections of Markdown documents, their breadcrumbs, and the merging of small ones.

Every window is partitioned by document, so that one exchange on doc_id serves them all.

Null texts are empty ones; an empty or blank text has no section, and an empty table none either. Documents with one
doc_id mix: ids are to be unique. Equal headings are told apart by ``sec``. Other columns are dropped unless they are named in
``also``, which takes any name but those of the result and ``_g``, ``_n``, ``m`` and ``x``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    LINE_END,
    heading_level,
    heading_text,
    is_blank,
    is_fence,
    rstrip,
    strip,
    strip_lf,
)


def joined_lines(pos: str, line: Column, keep: Column) -> Column:
    """Aggregate: kept lines in order, joined by LF."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(pos, line.alias("line")))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")


def parse_sections(docs: DataFrame, also: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """(doc_id, *also, sec, level, heading, body): headings outside code fences start sections; sec 0 is a preamble.

    An empty preamble goes, unless ``every`` asks for it, so that each document has a row.
    """
    # The line put first has no part in the result: it is the preamble of documents that start with a heading.
    split = F.concat(F.array(F.lit("")), F.split(F.coalesce("text", F.lit("")), LINE_END, -1))
    # Outer, though no text is without lines: else a filter on their number is put below, which works the text out twice.
    lines = docs.select("doc_id", *also, F.posexplode_outer(split).alias("pos", "line"))
    so_far = Window.partitionBy("doc_id").orderBy("pos")
    fence = is_fence(F.col("line"))
    fences = F.sum(fence.cast("int")).over(so_far)
    lines = lines.withColumn("is_heading", ~fence & (fences % 2 == 0) & (heading_level(F.col("line")) > 0))
    lines = lines.withColumn("sec", F.sum(F.col("is_heading").cast("int")).over(so_far))
    found = lines.groupBy("doc_id", "sec").agg(
        F.max(F.when(F.col("is_heading"), heading_level(F.col("line"))).otherwise(0)).alias("level"),
        F.max(F.when(F.col("is_heading"), heading_text(F.col("line"))).otherwise("")).alias("heading"),
        strip_lf(joined_lines("pos", F.col("line"), ~F.col("is_heading"))).alias("body"),
        *(F.first(c).alias(c) for c in also),
    )
    found = found if every else found.where("level > 0 or body <> ''")
    return found.select("doc_id", *also, F.col("sec").cast("int").alias("sec"), "level", "heading", "body")


def with_breadcrumbs(sections: DataFrame) -> DataFrame:
    """Add ``breadcrumb``, the open headings down to the section's own."""
    so_far = Window.partitionBy("doc_id").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    open_at = []
    for depth in range(1, 7):
        last = F.last(F.when(F.col("level").between(1, depth), F.struct("level", "heading")), ignorenulls=True).over(so_far)
        open_at.append(F.when((last["level"] == depth) & (F.col("level") >= depth), last["heading"]))
    return sections.withColumn("breadcrumb", F.array_compact(F.array(*open_at)))


def primary_levels(sections: DataFrame) -> DataFrame:
    """(doc_id, primary_level): the smallest level that occurs twice, else the smallest, else 2."""
    counts = sections.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    level = F.when(F.col("level") > 0, F.col("level"))
    best = F.coalesce(F.min(F.when(F.col("n") >= 2, level)), F.min(level), F.lit(2))
    return counts.groupBy("doc_id").agg(best.alias("primary_level"))


def document_titles(sections: DataFrame) -> DataFrame:
    """(doc_id, title) of documents with a heading of level 1: the first of them."""
    return sections.where("level = 1 and heading <> ''").groupBy("doc_id").agg(F.min_by("heading", "sec").alias("title"))


def with_document(sections: DataFrame) -> DataFrame:
    """Add the document's ``title`` (null if none) and ``primary_level`` by windows over the document."""
    doc = Window.partitionBy("doc_id")
    n = F.count("*").over(Window.partitionBy("doc_id", "level"))
    level = F.when(F.col("level") > 0, F.col("level"))
    titled = F.when((F.col("level") == 1) & (F.col("heading") != ""), F.struct("sec", "heading"))
    counted = sections.withColumn("_n", n)
    return counted.withColumns(
        {
            "primary_level": F.coalesce(F.min(F.when(F.col("_n") >= 2, level)).over(doc), F.min(level).over(doc), F.lit(2)),
            "title": F.min(titled).over(doc)["heading"],
        }
    ).drop("_n")


def merge_small_sections(walked: DataFrame, max_chars: int = 1800, also: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """Each primary section takes in the sections up to the next one if all fit in ``max_chars``.

    ``walked`` has doc_id, *also, sec, level, heading, body, breadcrumb, primary_level and title; so has
    the result. Sections before the first primary one stay as they are. Sections left without a body
    go where they say nothing, unless ``every`` asks for them.
    """
    so_far = Window.partitionBy("doc_id").orderBy("sec")
    group = F.sum((F.col("level") == F.col("primary_level")).cast("int")).over(so_far)
    grouped = walked.withColumn("_g", group)
    before = grouped.where("_g = 0").drop("_g")
    before = before if every else before.where(~((F.col("level") == 0) & is_blank(F.col("body"))))
    member = F.struct("sec", "level", "heading", "body", "breadcrumb")
    rows = (
        grouped.where("_g > 0")
        .groupBy("doc_id", *also, "_g", "primary_level", "title")
        .agg(F.array_sort(F.collect_list(member)).alias("m"))
    )
    first = F.get("m", F.lit(0))

    def text(x: Column, i: Column) -> Column:
        head = F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["heading"], F.lit("\n"), x["body"])
        return F.when(i > 0, rstrip(head)).when(~is_blank(x["body"]), x["body"])

    merged = strip(F.array_join(F.array_compact(F.transform("m", text)), "\n\n"))
    one = F.struct(
        first["sec"].alias("sec"), first["level"].alias("level"), first["heading"].alias("heading"),
        F.col("_merged").alias("body"), first["breadcrumb"].alias("breadcrumb"),
    )
    fits = (F.length("_merged") <= max_chars) | (F.size("m") == 1)
    apart = F.col("m") if every else F.filter("m", lambda x, i: (i > 0) | ~is_blank(x["body"]))
    out = rows.withColumn("_merged", merged).withColumn("x", F.explode(F.when(fits, F.array(one)).otherwise(apart)))
    return before.unionByName(out.select("doc_id", *also, "x.*", "primary_level", "title"))


def section_summary(body: Column, heading: Column, has_table: Column, limit: int = 300, back: int = 8) -> Column:
    """Up to ``limit`` characters, cut at a blank or heading line among the ``back`` lines before."""
    lines = F.split(body, "\n", -1)
    head = F.substring(body, 1, limit)
    over = F.size(F.split(head, "\n", -1))  # first line that starts beyond the limit
    start_of = lambda j: F.when(j > 0, F.length(F.array_join(F.slice(lines, F.lit(1), j), "\n")) + 1).otherwise(0)
    low = F.greatest(over - back, F.lit(0)) + 1
    steps = F.when(low <= over - 1, F.sequence(low, F.greatest(over - 1, low))).otherwise(F.array().cast("array<int>"))
    good = F.filter(steps, lambda j: is_blank(F.get(lines, j)) | strip(F.get(lines, j)).startswith("#"))
    cut = F.when((over < F.size(lines)) & (F.size(good) > 0), start_of(F.element_at(good, -1)))
    preview = strip(F.substring(body, F.lit(1), F.coalesce(cut, F.lit(limit))))
    marked = F.when(has_table, F.concat(F.lit("本章节包含表格数据: "), heading, F.lit("\n\n"), preview)).otherwise(preview)
    return F.when(F.length(body) <= limit, body).otherwise(marked)


def walked_sections(docs: DataFrame, also: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """Sections with breadcrumb, primary level and title."""
    return with_document(with_breadcrumbs(parse_sections(docs, also, every)))
