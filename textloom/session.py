"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom"
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
        _shipped.add(app)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's checkpoint folder, which goes when the application ends; a temporary one only where nothing leaves this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a shared folder: later stages read only the columns they need, and a lost executor costs no more than its tasks."""
    path = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
