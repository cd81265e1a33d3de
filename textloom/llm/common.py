"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, and the bytes between words: what ``bytes.split()`` splits on.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured and nothing leaves this machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``scratch_folder`` before the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a new scratch folder and read again, and that folder."""
    path = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``_k, _t``, never null, which tell rows apart by id and text.

    Rows that agree in both have the same text, so whatever is worked out for one of
    them holds for all of them.
    """
    return df.withColumns({"_k": F.xxhash64("doc_id"), "_t": F.xxhash64("text")})


def hot_values(counts: DataFrame, column: str, share: float = 0.001, least: int = 1000) -> list:
    """Values of ``column`` that have over ``share`` of all rows (and ``least``), from (``column``, n): at most 1 / share."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") > max(int(share * total), least)).groupBy(column).agg(F.lit(1))
    return [r[0] for r in often.select(column).collect()]


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: list, seed: list[str], salts: int = 64, how: str = "inner") -> DataFrame:
    """Inner or left join of ``many`` with ``one``, which has a row per key; rows whose first key is in ``hot`` are met in ``salts`` parts, told apart by ``seed``."""
    if not hot:
        return many.join(one, keys, how)
    often = F.col(keys[0]).isin(hot)
    left = many.withColumn("_salt", F.when(often, F.pmod(F.xxhash64(*seed), F.lit(salts)).cast("int")).otherwise(0))
    parts = F.when(often, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(one.withColumn("_salt", F.explode(parts)), [*keys, "_salt"], how).drop("_salt")


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives no bytes."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def portions(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about ``limit`` bytes, so that what is made of one at a time stays small."""
    for batch in batches:
        step = max(batch.num_rows * limit // max(batch.nbytes, 1), 1)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_rows(
    df: DataFrame,
    kernel: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]],
    keep: list[str],
    added: str,
    portion: int = 1 << 22,
) -> DataFrame:
    """``df.select(keep)`` with the columns ``added`` (DDL) that ``kernel`` makes from each batch of about ``portion`` bytes.

    The kept columns pass through as Arrow arrays, so nulls and large integers stay as they are.
    """
    new = T.StructType.fromDDL(added)
    schema = T.StructType([df.schema[c] for c in keep] + new.fields)
    target = arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, portion):
            made = kernel(batch)
            arrays = [batch.column(c) for c in keep]
            arrays += [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *target.names])

    return df.mapInArrow(run, schema)


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add the 0-based rank of each row in ``order`` without bringing all rows to one task.

    Rows are range-partitioned and numbered within their partition; only the number of rows
    of each partition goes through the driver. ``order`` must not have ties.
    """
    from pyspark.sql import Window

    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p] = total
        total += n
    start = F.create_map([F.lit(x) for kv in starts.items() for x in kv])[F.col("_p")] if starts else F.lit(0)
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn(name, (start + local).cast("long")).drop("_p")
