"""Incremental runs: new files are cleaned and chunked as they come, finished ones stay finished."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import slug
from ..plans.prepare import prepare_documents
from ..sources.files import decoded, split_path, write_chunks


def stream_documents(spark: SparkSession, base: str) -> DataFrame:
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(base)
    path = F.col("_metadata.file_path")
    parts = split_path(decoded(path), base)
    return files.select(
        F.xxhash64(path).alias("doc_id"), F.concat(parts["stem"], F.lit(".md")).alias("source"), slug(parts["stem"]).alias("id_prefix"),
        parts["company"].alias("company"), F.regexp_replace("value", "\r\n?", "\n").alias("text"),
    )


def chunk_stream(spark: SparkSession, base: str, out: str, checkpoint: str) -> StreamingQuery:
    """Run over the files that came since the last run, then stop. The checkpoint knows what is done.

    Chunking needs windows over whole documents, which a stream can't have; each micro-batch holds
    whole files, so it is done per batch. A batch that is run again takes the place of its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_chunks(prepare_documents(batch), f"{out}/batch={batch_id}")

    return stream_documents(spark, base).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
