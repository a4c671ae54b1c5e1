"""Shared plumbing: table reads, scratch tables, batch maps, hash-ordered samples.

All operators read with Spark's own readers (any file system that Spark knows) and keep
intermediate tables in the folder that ``spark.checkpoint.dir`` names, so a lost executor costs
only the tasks it ran.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.checkpoints import at_end, delete, shared_folder
from ..plans.shipping import ship


#: Bounds of an Arrow batch, set by every Python stage on a session that has none of its own: workers share an executor's memory with its heap.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    return shared_folder(spark)


#: Spark's setting that lets an execution's shuffle files go when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persist_table(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage durably.

    The table goes with ``drop_table``, or when the process ends. With ``free`` the shuffle files of
    the write go as soon as it is done; ``df`` is not to be run again.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    known = spark.conf.get(FREE_SHUFFLES, None)
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE_SHUFFLES) if known is None else spark.conf.set(FREE_SHUFFLES, known)
    at_end(lambda: delete(spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stemma_path = path  # type: ignore[attr-defined]
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by ``persist_table``; nothing may read it afterwards."""
    path = getattr(df, "_stemma_path", None)
    if path:
        delete(df.sparkSession, path)


def map_batches(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Apply ``fn(*columns as Python lists)`` to each Arrow batch of ``df``; ``fn`` returns row tuples.

    ``fn`` may be a factory result holding per-task state: it is called once per batch in order.
    """
    out_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = fn(*(c.to_pylist() for c in batch.columns))
            yield rows_to_batch(rows, out_schema)

    return df.mapInArrow(run, schema)


def rows_to_batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def _arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)  # every Python stage asks for its schema first
    for key, value in (("maxRecordsPerBatch", str(BATCH_ROWS)), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if _is_default(spark, name):  # plans are made when they run, so this can't be taken back; a caller's own value stays
            spark.conf.set(name, value)
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _is_default(spark: SparkSession, name: str) -> bool:
    return not spark._jsparkSession.sessionState().conf().contains(name)


def with_columns_schema(docs: DataFrame, names: list[str], added: str) -> StructType:
    """The fields of ``names`` and then those of ``added`` (DDL)."""
    return StructType([docs.schema[c] for c in names] + StructType.fromDDL(added).fields)


def spread_pieces(text: Column, size: int, count: int) -> Column:
    """At most ``count`` stretches of ``size`` characters of a text, evenly spread from its start to its end."""
    n = F.length(text)
    many = F.least(F.ceil(n / size), F.lit(count)).cast("int")
    gap = F.when(n <= size * count, F.lit(size)).otherwise(F.floor((n - size) / (count - 1)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(text, 1 + i * gap, F.lit(size)))).otherwise(F.array().cast("array<string>"))


#: What one operator keeps in a Python worker from task to task; workers outlive stages.
worker_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """The owner's cache in this worker; other owners' caches are let go."""
    for other in [k for k in worker_caches if k != owner]:
        del worker_caches[other]
    return worker_caches.setdefault(owner, {})


def trim_worker() -> None:
    """Give freed memory back to the system; a worker's next stage may be another operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def alone(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker without the caches that earlier stages left."""

    def alone_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("").clear()
        trim_worker()
        yield from run(batches)
        trim_worker()

    return alone_run


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def hashed_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest key hash: bounded, repeatable, independent of layout."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)
