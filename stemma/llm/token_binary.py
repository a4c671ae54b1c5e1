"""Token-id / binary output: frequency-ranked ids, byte-aligned variable-length, separate control bytes.

Format ("SVB1", one block in each row of the output table's ``block`` column, little-endian):

    4s magic, u32 documents, u64 ids | i64 doc_id[documents] | u32 ids of each document[documents]
    | control bytes, 2 bits an id (its byte count less one, first id lowest) | data bytes of the ranks

and one rank table, in the row whose ``part`` is -1:

    4s magic "SVBR", u32 ranks | u32 id of each rank[ranks]

A rank is the place of an id when all ids of the corpus are ordered by falling frequency (ties by
id), so the commonest 256 ids take one byte. Control and data bytes stand apart: a control byte
indexes a table of four lengths, and a running sum of these gives every id's place at once. The
files hold all that reading them takes: ``read_token_blocks`` needs their path alone.

Blocks are written in ascending doc_id order (range partitions, sorted inside) by Spark's own
Parquet writer, whose commit protocol covers lost executors; they are read back from that table.

Defined cases: null text counts as empty (only the end id); a text of any length is one document,
in a block of its own where it is longer than ``block_ids``; an empty table gives no block; rows
that repeat a doc_id stay apart, in unspecified order among themselves; null doc_ids sort first and
are counted in ``null_docs``, their places holding the smallest long. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import at_end, delete
from .common import _arrow_schema, drop_table, persist_table, rows_to_batch, scratch_root
from .tokens import END_ID, default_path, encoder, slices

MAGIC, RANKS_MAGIC = b"SVB1", b"SVBR"
#: Ids of one writer task, about: tasks grow in number with the corpus.
PART_IDS = 1 << 24
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_HEAD, _RANKS_HEAD = struct.Struct("<4sIQ"), struct.Struct("<4sI")
_SCHEMA = "part int, before long, n_ids long, null_docs int, block binary"


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint32 ranks to (control bytes, data bytes)."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, raw[np.arange(4) < size[:, None]]


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The inverse, by table lookup on the control bytes."""
    size = LENGTHS[control].reshape(-1)[:count]
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def build_block(doc_ids: list[int], lens: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    return b"".join([_HEAD.pack(MAGIC, len(doc_ids), len(ranks)), np.array(doc_ids, "<i8").tobytes(), np.array(lens, "<u4").tobytes(), control.tobytes(), data.tobytes()])


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, ranks)."""
    magic, docs, ids = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not an SVB1 block")
    raw = np.frombuffer(block, np.uint8)
    at = _HEAD.size
    doc_ids = raw[at : at + 8 * docs].view("<i8")
    at += 8 * docs
    lens = raw[at : at + 4 * docs].view("<u4")
    at += 4 * docs
    quads = -(-ids // 4)
    return doc_ids, lens, decode_ranks(raw[at : at + quads], raw[at + quads :], ids)


def build_ranks(by_rank: np.ndarray) -> bytes:
    return _RANKS_HEAD.pack(RANKS_MAGIC, len(by_rank)) + by_rank.astype("<u4").tobytes()


def read_ranks(block: bytes) -> np.ndarray:
    """The id of each rank."""
    magic, n = _RANKS_HEAD.unpack_from(block)
    if magic != RANKS_MAGIC:
        raise ValueError("not a rank table")
    return np.frombuffer(block, "<u4", n, _RANKS_HEAD.size)


def _tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of kind 0: a document's ids (16 or 32 bits, deflated); kind 1: id counts of a batch."""
    schema = "kind int, doc_id long, wide boolean, ids binary"
    out = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, squeeze = encoder(path), zstandard.ZstdCompressor(level=1)
        counts = np.zeros(enc.tokenizer.get_vocab_size() + 1, np.int64)
        for keys, texts in slices(batches):
            rows, found = [], [np.append(ids, np.uint32(end_id)) for ids in enc.encode(texts)]
            seen = np.bincount(np.concatenate(found))  # once a slice: the vocabulary is longer than most documents
            if len(seen) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(seen) - len(counts), np.int64)])
            counts[: len(seen)] += seen
            for key, ids in zip(keys, found):
                wide = int(ids.max()) > 0xFFFF
                rows.append((0, key, wide, squeeze.compress(ids.astype("<u4" if wide else "<u2").tobytes())))
            yield rows_to_batch(rows, out)
        if counts.any():
            yield rows_to_batch([(1, None, None, squeeze.compress(counts.astype("<i8").tobytes()))], out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _frequency_order(tokenized: DataFrame) -> tuple[np.ndarray, int]:
    """Ids by falling frequency, and how many there are in all; the driver gets one row an id of the vocabulary."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                counts = np.frombuffer(zstandard.decompress(blob), "<i8")
                ids = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], names=["id", "n"])

    rows = tokenized.where("kind = 1").select("ids").mapInArrow(spread, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32), int(n.sum())


def write_token_blocks(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, block_ids: int = 1 << 20, partitions: int | None = None) -> str:
    """Encode ``docs`` (doc_id, text) into a table of blocks in the shared folder; returns its path."""
    spark = docs.sparkSession
    tokenized = persist_table(_tokenize(docs, tokenizer_path or default_path(), end_id), "tokens")
    by_rank, total = _frequency_order(tokenized)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)  # at most a vocabulary
    out = _arrow_schema(spark, _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, part, before = zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), 0
        ids, lens, ranks, held, nulls = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return rows_to_batch([(part, before, held, nulls, build_block(ids, lens, np.concatenate(ranks)))], out)

        for batch in batches:
            for key, wide, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rank = table.value[np.frombuffer(expand.decompress(blob), "<u4" if wide else "<u2")]
                if held and (held + len(rank) > block_ids or (key is None) != (nulls == len(ids) > 0)):
                    yield flush()
                    before, ids, lens, ranks, held, nulls = before + held, [], [], [], 0, 0
                ids.append(-(2**63) if key is None else key)
                nulls += key is None
                lens.append(len(rank))
                ranks.append(rank)
                held += len(rank)
        if held:
            yield flush()

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_IDS), 1)
    ordered = tokenized.where("kind = 0").select("doc_id", "wide", "ids").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    head = spark.createDataFrame([(-1, 0, 0, 0, build_ranks(by_rank))], _SCHEMA)
    path = f"{scratch_root(spark)}/svb-{uuid.uuid4().hex}"
    ordered.mapInArrow(run, _SCHEMA).write.parquet(path)
    head.coalesce(1).write.mode("append").parquet(path)
    drop_table(tokenized)
    return path


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Decode a block table: doc_id, start (ids before it in the whole output), n_tokens, ids (array)."""
    return _decode(spark, path, "doc_id long, start long, n_tokens long, ids array<long>", lambda ids: ids.astype(np.int64).tolist())


def digest_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks."""
    return _decode(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _decode(spark: SparkSession, path: str, schema: str, value) -> DataFrame:
    stored = spark.read.schema(_SCHEMA).parquet(path)
    by_rank = read_ranks(stored.where("part = -1").select("block").first()["block"])  # at most a vocabulary
    blocks = stored.where("part >= 0")
    # A block knows the ids before it in its own partition; one total for each partition of the writer does the rest.
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts = dict(zip(sorted(totals), np.cumsum([0, *(totals[p] for p in sorted(totals))]).tolist()))
    table = spark.sparkContext.broadcast((by_rank, starts))
    out = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, before_part = table.value
        for batch in batches:
            for part, before, nulls, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
                start = before_part[part] + before
                keys, lens, ranks = read_block(block)
                ids = id_of[ranks] if len(ranks) else ranks
                ends = np.cumsum(lens, dtype=np.int64)
                rows = [(None if i < nulls else int(k), int(start + e - n), int(n), value(ids[e - n : e])) for i, (k, n, e) in enumerate(zip(keys, lens, ends))]
                yield rows_to_batch(rows, out)

    return blocks.select("part", "before", "null_docs", "block").mapInArrow(run, schema)


def op5_token_binary(docs: DataFrame, **options) -> DataFrame:
    spark, path = docs.sparkSession, write_token_blocks(docs, **options)
    at_end(lambda: delete(spark, path))  # the query returns digests; who wants the files writes them
    return digest_token_blocks(spark, path)
