"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, shuffle each, write.

Pass 1 gives every record a seeded 64-bit hash of its id, text checksum and size; the hash picks one
of ``buckets``, and Spark's own shuffle carries the record there. Records that repeat one another in
all of these would share a bucket, so the k-th repeat inside a task is hashed with the task and k as
well; a third of all rows may be one record. Pass 2 takes the buckets one at a time: a task's rows
come sorted by bucket and hash (Spark spills), so a bucket's rows have a fixed first order, and
numpy's Fisher-Yates, seeded by (seed, bucket), shuffles them. They are written in that order with
their bucket and place. The result depends on the records and the seed, not on layout or retries
(but for which of some equal records comes first).

The written order of the buckets, one after the other, is a uniform shuffle of the table. A shard is
a stretch of it: with n rows and s shards, row p goes to shard floor(p * s / n), so counts are at
most one apart (law ``rows``), and the same files serve any number of shards. Where a bucket starts
is a prefix sum over bucket counts, made in Spark in two levels (``bucket_starts``).

Buckets number total bytes / ``bucket_bytes``. For a table the files' sizes tell, times ``SWELL`` for
compression; only the result of other plans, whose estimates can't be trusted, is measured in a scan.
A task of pass 1 remembers one hash a row, a task of pass 2 holds one bucket.

Defined cases: a null text has size 8 (no bytes) and checksum 0, an empty one too; null and repeated
ids are records like any other; equal texts are separate records and are scattered apart; a text of
any length is one record; an empty table gives no rows; with fewer rows than shards some shards stay
empty. All columns of the input are written, whatever their names (with ``d_`` before them in the
files); ``read_shards`` leaves out input columns that are called shard or slot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.checkpoints import at_end, delete
from .common import _arrow_schema, scratch_root, trim_worker

SHARDS, SEED = 24, 13
#: Bytes of a bucket, about, and of a task of the second pass.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 128 << 20
#: How many times larger rows are than a plan's estimate, which counts files' bytes.
SWELL = 4
#: Bucket starts up to which they are broadcast (16 bytes each); beyond that Spark joins as it sees fit.
MOST_BROADCAST = 1_000_000
LEAST_BUCKETS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's thirteenth)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def record_hashes(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """One seeded hash for each row of some int64 columns."""
    h = np.full(len(parts[0]), np.uint64(seed))
    for part in parts:
        h = _mix((h + np.uint64(0x9E3779B97F4A7C15)) ^ _mix(part.astype(np.uint64)))
    return h


def stored_name(name: str) -> str:
    """What a column is called in the files: no clash with ours, no dots or backticks."""
    return "d_" + name.replace("%", "%25").replace(".", "%2E").replace("`", "%60")


def _scatter(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``docs``, its columns under their stored names, with ``_bucket`` and ``_hash``."""
    identity = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull())
    checksum = F.coalesce(F.crc32("text"), F.lit(-1))
    size = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    fields = [StructField(stored_name(f.name), f.dataType) for f in docs.schema]
    checks = docs.select(*(F.col("`" + f.name.replace("`", "``") + "`").alias(stored_name(f.name)) for f in docs.schema), identity.alias("_id"), checksum.alias("_crc"), size.alias("_size"))
    schema = StructType([*fields, StructField("_bucket", IntegerType()), StructField("_hash", LongType())])
    out = _arrow_schema(docs.sparkSession, schema)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            h = record_hashes([np.asarray(batch.column(width + i)) for i in range(3)], seed)
            repeats = []
            for i, v in enumerate(h.tolist()):
                k = seen.get(v, 0)
                seen[v] = k + 1
                if k:
                    repeats.append((i, task, k))
            if repeats:
                at, tasks, times = (np.array(c, np.int64) for c in zip(*repeats))
                h[at] = record_hashes([h[at], tasks, times], seed)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(bucket), pa.array(_mix(h).view(np.int64))], schema=out)

    return checks.mapInArrow(run, schema)


def _shuffled(rows: DataFrame, tasks: int, seed: int) -> DataFrame:
    """Rows dealt to tasks by bucket, each bucket shuffled, with ``_place`` instead of ``_hash``."""
    schema = StructType([*rows.schema.fields[:-1], StructField("_place", LongType())])
    out = _arrow_schema(rows.sparkSession, schema)
    kept = len(rows.columns) - 1

    def shuffle(parts: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).select(range(kept)).combine_chunks()
        order = np.arange(table.num_rows)
        np.random.default_rng([seed, bucket]).shuffle(order)
        step = max(1, min(2000, (4 << 20) * table.num_rows // max(table.nbytes, 1)))
        for at in range(0, len(order), step):
            for piece in table.take(pa.array(order[at : at + step])).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.arange(at, at + piece.num_rows))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            buckets = np.asarray(batch.column(kept - 1))
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:]):
                if start == end:
                    continue
                if held and buckets[start] != last:
                    yield from shuffle(held, last)
                    held = []
                last = int(buckets[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from shuffle(held, last)
        trim_worker()

    return rows.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", "_hash").mapInArrow(run, schema)


def _bytes(docs: DataFrame) -> int:
    """About how many bytes the rows have: from file sizes where ``docs`` is columns of a table, else measured."""
    plan = node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    if node.nodeName() == "LogicalRelation":
        return SWELL * int(str(plan.stats().sizeInBytes()))
    return docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0


def write_shuffled(docs: DataFrame, seed: int = SEED, buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> str:
    """Shuffle ``docs`` (doc_id, text, ...) into a table of files in the shared folder, or at ``path``; returns its path."""
    spark, total = docs.sparkSession, _bytes(docs)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    tasks = min(tasks, 200_000)
    buckets = buckets or min(max(LEAST_BUCKETS, 4 * tasks, -(-total // bucket_bytes)), 2**31 - 1)
    path = path or f"{scratch_root(spark)}/shuffled-{uuid.uuid4().hex}"
    _shuffled(_scatter(docs, buckets, seed), tasks, seed).write.parquet(path)
    return path


def bucket_starts(shuffled: DataFrame) -> DataFrame:
    """_bucket, start (rows before it), total (rows in all): sums inside blocks of buckets, then over blocks."""
    counts = shuffled.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.shiftright("_bucket", 11))
    before = Window.partitionBy("block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m"))  # one in 2,048 buckets
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("block", F.coalesce(F.sum("m").over(over), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = counts.select("_bucket", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inner"))
    return inside.join(placed, "block").select("_bucket", (F.col("base") + F.col("inner")).alias("start"), "total")


def read_shards(spark: SparkSession, path: str, shards: int = SHARDS, columns: dict[str, Column] | None = None) -> DataFrame:
    """The written rows (or ``columns`` of them) with ``shard`` and ``slot``, for any number of shards."""
    rows = spark.read.parquet(path)
    starts = bucket_starts(rows)
    bound = rows.agg(F.max("_bucket")).first()[0] or 0
    starts = F.broadcast(starts) if bound < MOST_BROADCAST else starts
    stored = {unquote(c[2:]): F.col(f"`{c}`") for c in rows.columns if c.startswith("d_")}
    names = columns or {c: v for c, v in stored.items() if c.lower() not in ("shard", "slot")}
    place = F.col("start") + F.col("_place")
    shard = F.expr(f"({shards} * (start + _place)) div total")
    first = F.expr(f"(total * (({shards} * (start + _place)) div total) + {shards - 1}) div {shards}")  # of a shard: its least p with p * shards >= shard * total
    return rows.select("_bucket", "_place", *(v.alias(f"_c{i}") for i, v in enumerate(names.values()))).join(starts, "_bucket").select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), shard.cast("int").alias("shard"), (place - first).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``, from the written files; these go when the process ends."""
    spark, path = docs.sparkSession, write_shuffled(docs, seed, **options)
    at_end(lambda: delete(spark, path))
    return read_shards(spark, path, shards)


def op13_external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    spark, path = docs.sparkSession, write_shuffled(docs, seed, **options)
    at_end(lambda: delete(spark, path))
    digests = {
        "doc_id": F.col("d_doc_id"),
        "size": F.coalesce(F.octet_length("d_text"), F.lit(0)).cast("long") + 8,
        "text_crc32": F.coalesce(F.crc32("d_text"), F.lit(0)),
        "law": F.lit("rows"),
    }
    return read_shards(spark, path, shards, digests).withColumn("grown_shard", F.lit(None).cast("int"))
