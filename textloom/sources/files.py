"""Reading and writing documents, pages and chunks as files, and planning batches of them.

An empty folder or table gives an empty result; empty files give documents with an empty text and no pages. Files are told
apart by their paths, so repeated contents stay apart. Writers take nulls as they are and ignore further columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.chunks import CHUNK, chunk_records, review_rows

#: Fixed list: folder names that are no company.
NO_COMPANY = ("output", "input", "data", "md", "markdown", "docs")
#: Bytes up to which a file of pages is read whole. A task holds some ten times that while it cuts one.
WHOLE = 1 << 20


def split_path(path: Column, base: str) -> dict[str, Column]:
    """company (first folder below ``base``), dir, stem of a path."""
    below = F.regexp_replace(path, rf"\A(?:[a-z]+:/*)?\Q{base.rstrip('/')}\E/", "")
    return {
        "company": F.regexp_extract(below, r"\A([^/]+)/", 1),
        "dir": F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1),
        "stem": F.regexp_extract(path, r"([^/]*)\.[^./]*\z", 1),
    }


def decoded(path: Column) -> Column:
    """A path as files are named, from the form in which Spark gives it, with blanks and percent signs encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_documents(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, source, id_prefix, company, text) of every .md file below ``base``, line ends as LF."""
    files = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"))
    parts = split_path(decoded(F.col("path")), base)
    return files.select(
        F.xxhash64("path").alias("doc_id"),
        F.concat(parts["stem"], F.lit(".md")).alias("source"),
        slug(parts["stem"]).alias("id_prefix"),
        parts["company"].alias("company"),
        F.regexp_replace("value", "\r\n?", "\n").alias("text"),
    )


def read_pages(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, path, page_no, text) of every page of the .txt files below ``base``; a form feed ends a page.

    ``doc_id`` is that of the .md file of the same name beside it. Pages are numbered from 1, blank ones too; what follows the
    last form feed is a page if it isn't empty. Files of up to ``WHOLE`` bytes, or of a split if those are smaller, are read
    once, whole, and numbered where they are cut. Others are read by blocks (``block_pages``).
    """
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size, most = F.col("_metadata.file_size"), min(WHOLE, split)
    below = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.txt")
    files = below.format("binaryFile").load(base)
    # Files of another size are left out by the listing, not opened; the folder is listed again only if there is a large one.
    found = whole_pages(files.where(size.between(1, most)))
    if not files.where(size > most).select("path").isEmpty():
        found = found.unionByName(block_pages(below.text(base, lineSep="\f").where(size > most)))
    return found.select(
        F.xxhash64(F.regexp_replace("path", r"\.txt\z", ".md")).alias("doc_id"), decoded(F.col("path")).alias("path"), "page_no", F.regexp_replace("text", "\r\n?", "\n").alias("text")
    )


def whole_pages(files: DataFrame) -> DataFrame:
    """(path, page_no, text) of files, none of them empty, whose contents are read whole."""
    value = F.col("content").cast("string")
    # A byte order mark goes, as it does where Spark reads lines.
    text = F.when(F.startswith(value, F.lit("\ufeff")), F.substring(value, 2, WHOLE)).otherwise(value)
    held = files.select(F.col("_metadata.file_path").alias("path"), F.split(text, "\f").alias("pieces"))
    last = F.size("pieces") - 1
    pages = F.when(F.get("pieces", last) == "", F.slice("pieces", 1, last)).otherwise(F.col("pieces"))
    return held.select("path", F.posexplode(pages).alias("i", "text")).select("path", (F.col("i") + 1).alias("page_no"), "text")


def block_pages(lines: DataFrame) -> DataFrame:
    """(path, page_no, text) of files read in lines that form feeds end.

    A long file is read by many tasks, each from the first page that starts in its block, so pages are numbered within their
    block and moved on by the pages of the blocks before: small counts are joined, and no file is brought together. The files
    are read twice for that.
    """
    meta = F.col("_metadata")
    found = lines.select(F.col("value").alias("text"), meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    # Rows of a block follow each other in one task.
    blocks = found.groupBy("path", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return found.join(starts, ["path", "block"]).select("path", (F.col("row") + F.col("shift")).cast("int").alias("page_no"), "text")


def company_of(path: Column) -> Column:
    """The folder that holds a file, unless its name says nothing."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*\z", 1)
    return F.when(~F.lower(folder).isin(*NO_COMPANY), folder).otherwise("")


def pair_pages(paths: DataFrame, base: str) -> DataFrame:
    """(company, dir, stem, md_path, pdf_path): each .md with the .pdf of its name beside it, or null."""
    parts = paths.withColumns(split_path(F.col("path"), base))
    md = parts.where(F.col("path").endswith(".md")).withColumnRenamed("path", "md_path")
    pdf = parts.where(F.col("path").endswith(".pdf")).select("dir", "stem", F.col("path").alias("pdf_path"))
    return md.join(pdf, ["dir", "stem"], "left").select("company", "dir", "stem", "md_path", "pdf_path")


def pending(tasks: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Tasks without a finished output (company, stem)."""
    return tasks if force else tasks.join(done.select("company", "stem"), ["company", "stem"], "left_anti")


def in_order(tasks: DataFrame) -> DataFrame:
    """Tasks by company, then path, with ``file_no``, their number within the company, from 1."""
    number = F.row_number().over(Window.partitionBy("company").orderBy("md_path"))
    return tasks.withColumn("file_no", number).orderBy("company", "file_no")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Have ``write`` fill a hidden folder beside ``path``, which then takes the place of ``path`` by renaming.

    Readers see the old output whole until the new one is whole. A failed run leaves the old one and nothing else; a killed
    one may leave a folder that starts with a dot, which readers skip. A rerun gives the same. The store must rename folders
    as one, as distributed file systems do.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    run = uuid.uuid4().hex
    final = at(path)
    staged, old = (at(final.getParent(), f".{final.getName()}-{run}{end}") for end in ("", "-old"))
    store = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(staged.toString())
        replaced = store.exists(final)
        if replaced and not store.rename(final, old):
            raise OSError(f"can't move {path} away")
        if not store.rename(staged, final):
            if replaced:
                store.rename(old, final)
            raise OSError(f"can't publish {path}")
    except BaseException:
        store.delete(staged, True)
        raise
    store.delete(old, True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of the 22 fields, published as one; nulls are written."""
    publish(chunks.sparkSession, path, chunk_records(chunks).write.option("ignoreNullFields", "false").json)


def write_review(chunks: DataFrame, path: str) -> None:
    publish(chunks.sparkSession, path, review_rows(chunks).write.option("header", "true").option("escape", '"').csv)


def write_text(texts: DataFrame, path: str) -> None:
    publish(texts.sparkSession, path, texts.select("md").write.text)
