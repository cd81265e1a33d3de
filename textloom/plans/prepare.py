"""The whole preparation of documents: clean, recover levels, chunk, attribute pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_markdown
from ..operators.chunks import chunk_documents
from ..operators.pages import attribute_pages
from ..operators.structure import recover_structure


def prepare_documents(
    docs: DataFrame,
    levels: DataFrame | None = None,
    pages: DataFrame | None = None,
    max_chars: int = 1800,
    overlap: int = 80,
    stitch: bool = True,
    dedup: bool = True,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Chunks of ``docs`` (doc_id, source, id_prefix, company, text), with pages if page texts are given.

    ``vectors`` are those of ``paragraphs_to_embed`` over the cleaned documents with their levels.
    """
    cleaned = clean_markdown(docs, stitch, dedup)
    chunks = chunk_documents(recover_structure(cleaned, levels), max_chars, overlap, vectors)
    if pages is None:
        return chunks
    return attribute_pages(chunks.withColumn("chunk", F.col("chunk_id")), pages).drop("chunk")
