"""Layered chunks of a document: summary, sections, leaves and table rows.

Sections are worked out once and written to the shared folder, from which all layers are made; so are the numbered
chunks, to which the lists of children and siblings are joined. A document is read and cleaned once.

Null and empty texts give the summary alone. Null ids make a document of their own, whose chunks have no lists; documents with one
doc_id mix. A null source and title give a summary without text. Headings, tables and rows that repeat are chunks
each. An empty table gives no chunk. Columns other than those named are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_table, context_text, is_blank, let, token_estimate
from ..session import written
from .blocks import BLOCK, long_paragraphs, recursive_split, semantic_texts, split_blocks, split_table, table_rows
from .sections import merge_small_sections, section_summary, walked_sections

#: Labels that readers of the chunks see.
CONTENTS = "本文件包含以下章节:\n"
SUBTABLE = "（子表 ", "/", "）"
ROW_LABEL = " 行 "

#: The 22 fields of a chunk, in output order.
CHUNK = (
    "chunk_id string, source string, breadcrumb array<string>, section_title string, heading_level int, "
    "content string, content_with_context string, char_count int, est_token_count int, has_table boolean, "
    "table_caption string, is_split_part boolean, split_part_index int, split_part_total int, "
    "page_start int, page_end int, chunk_type string, parent_id string, children_ids array<string>, "
    "sibling_ids array<string>, content_type string, company string"
)


#: What chunks need of their document besides its sections.
DOCUMENT = ("source", "id_prefix", "company")


def titled_sections(docs: DataFrame, max_chars: int = 1800, every: bool = False) -> DataFrame:
    """Merged sections with text, the document's title first in each breadcrumb; with ``every`` also the others, and DOCUMENT."""
    also = DOCUMENT if every else ()
    merged = merge_small_sections(walked_sections(docs, also, every), max_chars, also, every)
    merged = merged if every else merged.where(~is_blank(F.col("body")))
    lacks = F.col("title").isNotNull() & F.coalesce(F.get("breadcrumb", F.lit(0)) != F.col("title"), F.lit(True))
    full = F.when(lacks, F.concat(F.array("title"), "breadcrumb")).otherwise(F.col("breadcrumb"))
    return merged.withColumns({"breadcrumb": full, "has_table": contains_table(F.col("body"))})


def summaries_of(sections: DataFrame) -> DataFrame:
    """``document_summaries`` of ``titled_sections`` with every section, and DOCUMENT: primary headings outlast merging."""
    listed = F.when((F.col("level") == F.col("primary_level")) & (F.col("heading") != ""), F.struct("sec", "heading"))
    found = sections.groupBy("doc_id", *DOCUMENT).agg(F.max("title").alias("title"), F.array_sort(F.collect_list(listed)).alias("h"))
    named = found.withColumn("name", F.coalesce("title", "source"))
    items = F.array_join(F.transform("h", lambda x: F.concat(F.lit("- "), x["heading"])), "\n")
    more = F.when(F.size("h") > 0, F.concat(F.lit(CONTENTS), items)).otherwise("")
    return named.select("doc_id", *DOCUMENT, "title", "name", F.concat("name", F.lit("\n\n"), more).alias("content"))


def document_summaries(docs: DataFrame, max_chars: int = 1800) -> DataFrame:
    """(doc_id, title, name, content): the title and the headings of the primary level, for every document."""
    return summaries_of(titled_sections(docs, max_chars, every=True)).drop(*DOCUMENT)


def section_chunks(sections: DataFrame, max_chars: int = 1800) -> DataFrame:
    """The section layer of ``titled_sections``: whole bodies, or summaries of those that are too long."""
    long = F.length("body") > max_chars
    content = F.when(long, section_summary(F.col("body"), F.col("heading"), F.col("has_table"))).otherwise(F.col("body"))
    made = sections.withColumns({"is_long": long, "content": content})
    context = F.concat(F.lit("# "), F.array_join("breadcrumb", " > "), F.lit("\n\n"), F.col("content"))
    return made.withColumns(
        {
            "context": context,
            "est_token_count": token_estimate(F.when(F.col("is_long"), F.col("content")).otherwise(context)),
            "caption": F.when(F.col("has_table") & ~F.col("is_long"), F.col("heading")),
            "content_type": F.when(F.col("has_table"), "table").otherwise("prose"),
        }
    )


def table_parts(blocks: DataFrame, max_chars: int = 1800) -> DataFrame:
    """Sub-tables of table blocks: adds ``part``, ``parts`` and ``content``; small tables are one part."""
    tables = blocks.where("kind = 'table'")
    whole = F.length("text") <= max_chars
    cut = F.when(whole, F.array("text")).otherwise(split_table(F.col("text"), max_chars))
    return tables.withColumn("_s", cut).select(
        *blocks.columns, F.size("_s").alias("parts"), F.posexplode_outer("_s").alias("part", "content")
    ).withColumn("part", F.col("part") + 1)


def row_contents(table: Column) -> Column:
    """Each data row of a table with header and separator.

    Lines with three dashes don't count as rows, so the separator goes and, of what is left,
    the first line.
    """

    def made(rows: Column) -> Column:
        head = F.concat(F.get(rows, F.lit(0)), F.lit("\n"), F.get(rows, F.lit(1)), F.lit("\n"))
        plain = F.filter(rows, lambda x: ~x.contains("---"))
        return F.transform(F.slice(plain, F.lit(2), F.greatest(F.size(plain) - 1, F.lit(0))), lambda x: F.concat(head, x))

    return let(table_rows(table), made)


def row_chunks(parts: DataFrame) -> DataFrame:
    """One row per data row of tables that were cut: adds ``row`` and ``row_content``."""
    exploded = parts.where("parts > 1").select("*", F.posexplode(row_contents(F.col("content"))).alias("row", "row_content"))
    return exploded.withColumn("row", F.col("row") + 1)


def leaf_texts(blocks: DataFrame, max_chars: int = 1800, overlap: int = 80, vectors: DataFrame | None = None) -> DataFrame:
    """What blocks become: adds ``part``, ``parts``, ``row`` (0 for the part itself) and ``content``, in one pass."""
    table = F.col("kind") == "table"
    short = F.length("text") <= max_chars
    cut = F.when(short, F.array("text")).when(table, split_table(F.col("text"), max_chars)).otherwise(recursive_split("text", max_chars, overlap))
    whole = blocks if vectors is None else blocks.where(table)
    parts = whole.withColumn("_s", cut).select(*blocks.columns, F.size("_s").alias("parts"), F.posexplode_outer("_s").alias("part", "content"))
    parts = parts.withColumn("part", F.col("part") + 1)
    if vectors is not None:
        parts = parts.unionByName(prose_parts(blocks, max_chars, overlap, vectors).withColumn("parts", F.lit(1)))
    rows = F.when(table & (F.col("parts") > 1), row_contents(F.col("content"))).otherwise(F.array().cast("array<string>"))
    return parts.select(*blocks.columns, "part", "parts", F.posexplode_outer(F.concat(F.array("content"), rows)).alias("row", "content"))


def prose_parts(blocks: DataFrame, max_chars: int = 1800, overlap: int = 80, vectors: DataFrame | None = None) -> DataFrame:
    """Parts of prose blocks: adds ``part`` and ``content``. With ``vectors``, long blocks are first grouped by meaning."""
    prose = blocks.where("kind = 'prose'")
    if vectors is None:
        cut = prose.withColumn("_s", recursive_split("text", max_chars, overlap))
        return cut.select(*blocks.columns, F.posexplode_outer("_s").alias("part", "content")).withColumn("part", F.col("part") + 1)
    grouped = prose.join(semantic_texts(long_paragraphs(blocks, max_chars), vectors), list(BLOCK), "left")
    texts = grouped.select(*blocks.columns, F.posexplode(F.coalesce("texts", F.array("text"))).alias("_i", "_text"))
    cut = texts.withColumn("_s", recursive_split("_text", max_chars, overlap)).select(*blocks.columns, "_i", F.posexplode_outer("_s").alias("_j", "content"))
    return cut.withColumn("part", F.row_number().over(Window.partitionBy(*BLOCK).orderBy("_i", "_j"))).drop("_i", "_j")


def long_blocks(sections: DataFrame) -> DataFrame:
    """Blocks of the sections that are too long for one chunk, with what their chunks need of the section."""
    also = [c for c in DOCUMENT if c in sections.columns]
    long = sections.where("is_long").select("doc_id", *also, "sec", "body", "breadcrumb", "heading", "level")
    return split_blocks(long).join(long.drop("body"), ["doc_id", "sec"])


def paragraphs_to_embed(docs: DataFrame, max_chars: int = 1800) -> DataFrame:
    """(doc_id, sec, blk, para, text): the paragraphs whose vectors ``chunk_documents`` takes."""
    return long_paragraphs(long_blocks(section_chunks(titled_sections(docs, max_chars), max_chars)), max_chars)


def chunk_documents(docs: DataFrame, max_chars: int = 1800, overlap: int = 80, vectors: DataFrame | None = None) -> DataFrame:
    """All chunks of ``docs`` (doc_id, source, id_prefix, company, text), with doc_id and ``out_seq``.

    A leaf's id comes before its rows' ids, but its rows come first in the output. ``vectors`` are
    those of ``paragraphs_to_embed`` (doc_id, sec, blk, para, embedding): prose that is too long is cut
    where they break, and by characters only where a group is still too long.
    """
    every = written(section_chunks(titled_sections(docs, max_chars, every=True), max_chars), "sections")
    sections = every.where(~is_blank(F.col("body")))
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def layer(df: DataFrame, **columns: Column) -> DataFrame:
        defaults = {
            "sec": F.col("sec"), "blk": F.lit(0), "part": F.lit(0), "row": F.lit(0), "breadcrumb": F.col("breadcrumb"),
            "section_title": F.col("heading"), "heading_level": F.col("level"), "has_table": F.lit(False), "table_caption": none_text,
            "is_split_part": F.lit(False), "split_part_index": none_int, "split_part_total": none_int, "content_type": F.lit("prose"),
        }
        made = defaults | columns
        return df.select("doc_id", *DOCUMENT, *[c.alias(n) for n, c in made.items()])

    text = lambda content, context, tokens: {"content": content, "content_with_context": context, "est_token_count": tokens}
    content = F.col("content")
    doc_layer = layer(
        summaries_of(every), chunk_type=F.lit("doc_summary"), sec=F.lit(-1), section_title=F.col("name"), heading_level=F.lit(1),
        breadcrumb=F.when(F.col("title").isNotNull(), F.array("title")).otherwise(F.array().cast("array<string>")),
        **text(content, F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), content), token_estimate(content)),
    )
    sec_layer = layer(
        sections, chunk_type=F.lit("section"), has_table=F.col("has_table"), table_caption=F.col("caption"), content_type=F.col("content_type"),
        **text(content, F.col("context"), F.col("est_token_count")),
    )
    leaves = leaf_texts(long_blocks(sections), max_chars, overlap, vectors)
    table, is_row, number = F.col("kind") == "table", F.col("row") > 0, lambda c: F.col(c).cast("string")
    split = table & ~is_row & (F.col("parts") > 1)
    note = F.concat(F.col("heading"), F.lit(SUBTABLE[0]), number("part"), F.lit(SUBTABLE[1]), number("parts"), F.lit(SUBTABLE[2]))
    caption = F.when(is_row, F.concat(F.col("heading"), F.lit(ROW_LABEL), number("row"))).when(split, note).when(table, F.col("heading"))
    context = context_text(F.col("breadcrumb"), content)
    leaf_layer = layer(
        leaves, chunk_type=F.when(is_row, "table_row").otherwise("leaf"), blk=F.col("blk"), part=F.col("part"), row=F.col("row"), has_table=table,
        table_caption=caption, content_type=F.when(table, "table").otherwise("prose"), is_split_part=split,
        split_part_index=F.when(split, F.col("part")), split_part_total=F.when(split, F.col("parts")),
        **text(content, context, token_estimate(F.when(is_row, content).otherwise(context))),
    )
    return with_links(doc_layer.unionByName(sec_layer).unionByName(leaf_layer))


def with_links(chunks: DataFrame) -> DataFrame:
    """Add ids in creation order, parents, children, siblings, ``out_seq``, and the nested set ``enter`` and ``leave``.

    A chunk's descendants are those of its document whose ``enter`` lies between its own and its ``leave``.
    Lists are made once for each parent and each cut table, and joined to the rows that have them.
    """
    doc = Window.partitionBy("doc_id")
    created = doc.orderBy("sec", "blk", "part", "row")
    shown = doc.orderBy("sec", "blk", "part", F.when(F.col("row") == 0, F.lit(2**31 - 1)).otherwise(F.col("row")))
    numbered = chunks.withColumns({"enter": F.row_number().over(created), "out_seq": F.row_number().over(shown)})
    numbered = numbered.withColumn("chunk_id", F.format_string("%s_%04d", "id_prefix", "enter"))
    sec, part = Window.partitionBy("doc_id", "sec"), Window.partitionBy("doc_id", "sec", "blk", "part")
    own = lambda kind: F.when(F.col("chunk_type") == kind, F.col("chunk_id"))
    by_type = lambda *values: F.when(F.col("chunk_type") == "doc_summary", values[0]).when(F.col("chunk_type") == "section", values[1]).when(F.col("chunk_type") == "leaf", values[2]).otherwise(values[3])
    last = lambda w: F.max("enter").over(w)
    parent = by_type(F.lit(None).cast("string"), F.max(own("doc_summary")).over(doc), F.max(own("section")).over(sec), F.max(own("leaf")).over(part))
    placed = written(numbered.withColumns({"parent_id": parent, "leave": by_type(last(doc), last(sec), last(part), F.col("enter"))}), "chunks")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("enter", "chunk_id"))), lambda x: x["chunk_id"])
    none = F.array().cast("array<string>")
    # Lists stand once for each parent and each cut table, and are joined as such: one for each sibling would be the square of that.
    # They are never broadcast, since the size of a file says little of what lists made from it take.
    children = placed.where("chunk_type in ('section', 'leaf')").groupBy("doc_id", F.col("parent_id").alias("chunk_id")).agg(ids.alias("children_ids"))
    is_part = (F.col("chunk_type") == "leaf") & F.col("is_split_part")
    siblings = placed.where(is_part).groupBy("doc_id", "sec", "blk").agg(ids.alias("ids"))
    parts = placed.where(is_part).join(siblings.hint("merge"), ["doc_id", "sec", "blk"], "left").withColumn("children_ids", none)
    others = placed.where(~is_part).join(children.hint("merge"), ["doc_id", "chunk_id"], "left").withColumn("ids", none)
    linked = others.unionByName(parts).withColumn("sibling_ids", F.array_except("ids", F.array("chunk_id"))).drop("ids")
    return linked.withColumns(
        {
            "children_ids": F.coalesce("children_ids", none), "sibling_ids": F.coalesce("sibling_ids", none), "char_count": F.length("content"),
            "page_start": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int"),
        }
    )


def chunk_records(chunks: DataFrame) -> DataFrame:
    """The 22 output fields; missing captions and parents are written as empty strings."""
    names = [f.split(" ")[0] for f in CHUNK.split(", ")]
    filled = {"table_caption", "parent_id"}
    return chunks.select(*[F.coalesce(n, F.lit("")).alias(n) if n in filled else F.col(n) for n in names])


def review_rows(chunks: DataFrame, pages: bool = False) -> DataFrame:
    """Flat rows for review tables: lists joined, nulls empty; with ``pages`` also page_start and page_end, null where none matches."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return chunks.select(
        "chunk_id", "chunk_type", "source", "company", F.array_join("breadcrumb", " > ").alias("breadcrumb"), "section_title", "heading_level",
        "char_count", "est_token_count", "has_table", text("table_caption"), "is_split_part", text("split_part_index"), text("split_part_total"),
        text("parent_id"), F.array_join("children_ids", ", ").alias("children_ids"), F.array_join("sibling_ids", ", ").alias("sibling_ids"),
        "content_type", "content", "content_with_context", *["page_start", "page_end"] * pages,
    )
