"""Durable lineage cuts: tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The JVM and its Hadoop settings; both outlive a stopped session.
_hadoop: list = []
#: What takes away this process's scratch tables when it ends.
_made: list[Callable[[], object]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a single-machine session gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stemma-"))
        root = spark.sparkContext.getCheckpointDir()
    _hadoop[:] = [spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()]
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back (``checkpoint()`` would run its plan twice)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_end(lambda: delete(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; one made by a session that has been stopped goes too."""
    if not _hadoop:
        shared_folder(spark)
    jvm, settings = _hadoop
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(settings).delete(folder, True)


def at_end(undo: Callable[[], object]) -> None:
    _made.append(undo)


@atexit.register
def release() -> None:
    """Delete the scratch tables made so far; nothing may read them afterwards."""
    while _made:
        with contextlib.suppress(Exception):  # the session may be gone
            _made.pop()()
