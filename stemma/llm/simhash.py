"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints: 64 bits, one vote a 4-word shingle. Tables: every bit position i gets a vector v_i of
radius + 1 bits; for each of the 2^(radius+1) - 1 nonzero vectors a, a table keeps the bits with
<a, v_i> odd. Two fingerprints that differ in at most ``radius`` places have that many vectors at
most, some nonzero a is orthogonal to all of them, and in a's table the two agree: no pair within
the radius is missed.

Equal fingerprints are one row before any table is built. Inside a bucket nothing is paired: a
task joins the bucket's fingerprints into connected sets and sends one edge a member, so what
leaves a bucket is linear in it. A bucket larger than ``bucket_rows`` never reaches one task: its
rows are dealt anew by another covering family, whose masks keep half of the bits again, and so is
what is still too large. After ``DEALS`` deals a bucket's members agree on all but a few bits, so
few of them are left; such a bucket is cut into blocks, and each pair of blocks is one task.
Components then come from minimum labels with pointer jumping, each round written to the shared
checkpoint folder.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link like
any other; a text of any length votes with all its shingles; fewer than 4 words give one shingle of
them all; repeated rows share a component; a null doc_id is never the smallest of a component
unless it is alone (then the component is null); an empty table gives no rows. Extra columns of any
name are ignored by the query and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, alone, drop_table, persist_table, rows_to_batch

SHINGLE, RADIUS, BITS, SEED = 4, 4, 64, 42
BUCKET_ROWS, DEALS = 4096, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255):
        block = hashes[at : at + 255]
        for k in range(8):  # eight byte lanes hold counts of up to 255
            ones[k::8] += np.frombuffer(((block >> np.uint64(k)) & _LANES).sum(dtype=np.uint64).astype("<u8").tobytes(), np.uint8)
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist()))


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], words[3:]))
    return majority(np.array([digest(s, SEED) for s in shingles], np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64-bit long)."""
    schema = "doc_id long, fp long"
    out = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], schema=out)

    return docs.select("doc_id", "text").mapInArrow(alone(run), schema)


def covering_masks(radius: int, positions: list[int], seed: int = 1) -> list[int]:
    """Masks (sets of bit positions) such that any ``radius`` positions are all outside some mask."""
    width = radius + 1
    rng = np.random.default_rng(seed)
    vectors = np.resize(np.arange(1, 1 << width), len(positions))
    rng.shuffle(vectors)
    return [sum(1 << p for p, v in zip(positions, vectors) if bin(int(v) & a).count("1") & 1) for a in range(1, 1 << width)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def link_sets(fps: np.ndarray, radius: int, block: int = 2048) -> np.ndarray:
    """The representative (smallest index) of each fingerprint's connected set, in bounded blocks.

    Takes an unlabelled fingerprint, floods from it: each round compares the newly reached ones, a
    block at a time, with those not reached yet, which shrink.
    """
    n = len(fps)
    label = np.full(n, -1, np.int64)
    rest = np.arange(n)
    while len(rest):
        root = rest[0]
        label[root] = root
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), 64):
                seeds = fps[frontier[at : at + 64]]
                open_ = np.flatnonzero(~reached)
                for b in range(0, len(open_), block):
                    rows = open_[b : b + block]
                    near = (np.bitwise_count(fps[rest[rows]][:, None] ^ seeds[None, :]) <= radius).any(1)
                    reached[rows[near]] = True
            frontier = rest[reached]
            label[frontier] = root
            rest = rest[~reached]
    return label


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b), a < b as representative and member, that connect all fingerprints within ``radius``."""
    edges, deal, rows = None, 0, _deal(distinct.withColumn("bucket", F.lit(0).cast("long")), radius, 1)
    while True:
        sizes = persist_table(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1"), "buckets")
        pairs = sizes.where("n = 2 AND bit_count(low ^ high) <= %d" % radius).select(F.col("low").alias("a"), F.col("high").alias("b"))
        crowded = sizes.where(F.col("n").between(3, bucket_rows)).select("bucket")
        found = pairs.unionByName(_join_buckets(rows.join(crowded, "bucket", "left_semi"), radius))
        edges = found if edges is None else edges.unionByName(found)
        huge = sizes.where(F.col("n") > bucket_rows).select("bucket", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks"))
        if huge.isEmpty():
            return edges.distinct()
        if deal == DEALS:
            return edges.unionByName(_join_blocks(rows.join(huge, "bucket"), radius)).distinct()
        deal += 1
        rows = persist_table(_deal(rows.join(huge.select("bucket"), "bucket", "left_semi"), radius, deal + 1), "dealt")


def _deal(rows: DataFrame, radius: int, seed: int) -> DataFrame:
    """bucket, fp: each bucket's rows by what every mask of a covering family keeps; no pair within the radius is parted.

    A bucket's name is a hash. Buckets that share one are joined as one, and links are verified.
    """
    masks = [_signed(m) for m in covering_masks(radius, list(range(BITS)), seed)]
    each = rows.select("bucket", "fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("t", "mask"))
    return each.select(F.xxhash64("bucket", "t", F.expr("fp & mask"), F.lit(seed)).alias("bucket"), "fp")


def _parted(group: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Fingerprints of each group (equal neighbours of ``group``) that holds a pair within the radius."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    for n in range(2, 17):  # the many small groups of unrelated fingerprints, those of a size at once
        at = starts[sizes == n]
        for k in range(0, len(at), 4096):
            rows = fps[at[k : k + 4096, None] + np.arange(n)]
            near = np.bitwise_count(rows[:, :, None] ^ rows[:, None, :]) <= radius
            yield from rows[near.sum((1, 2)) > n]
    for a, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
        yield fps[a : a + n]


def _join_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Edges inside the buckets of (bucket, fp), which come sorted; a task holds a batch and one bucket."""
    schema = "a long, b long"
    out = _arrow_schema(rows.sparkSession, schema)

    def links(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for some in _parted(group, fps.view(np.uint64), radius):
            some = np.unique(some.view(np.int64))
            root = some[link_sets(some.view(np.uint64), radius)]
            a.append(root[root != some])
            b.append(some[root != some])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            group, fps = np.concatenate([group, batch.column(0).to_numpy()]), np.concatenate([fps, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last bucket may go on
            if whole:
                yield links(group[:whole], fps[:whole])
                group, fps = group[whole:], fps[whole:]
        if len(group):
            yield links(group, fps)

    return rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _join_blocks(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (bucket, fp, blocks): each pair of a bucket's blocks, of ``bucket_rows`` members or so, is one bucket."""
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), "blocks").cast("int")
    met = rows.select("bucket", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return _join_buckets(met.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp"), radius)


def components(edges: DataFrame, node: str = "fp", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node on an edge."""
    both = persist_table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = persist_table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("root").alias("seen"))
        lower = labels.join(around, "u").select("u", "root", F.least("root", "seen").alias("near"))
        jump = labels.select(F.col("u").alias("near"), F.col("root").alias("far"))
        moved = lower.join(jump, "near", "left").select("u", F.least("near", F.coalesce("far", "near")).alias("root"), F.col("root").alias("old"))
        fresh = persist_table(moved, "labels")
        done = fresh.where("root <> old").isEmpty()
        drop_table(labels)
        labels = fresh.drop("old")
        labels._stemma_path = fresh._stemma_path
        if done:
            drop_table(both)
            return labels.withColumnRenamed("u", node)
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id."""
    fps = persist_table(fingerprints(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fp"), radius))
    grouped = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(first, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each component the document with the smallest doc_id (one row of it), with its columns.

    Rows without a doc_id can't be named in a decision and stay.
    """
    return first_of_each(docs, near_duplicates(docs, radius))


def first_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keep_one`` keeps under the components of ``named`` (doc_id, component_id)."""
    chosen = named.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    rows = docs.select("doc_id", F.struct("*").alias("row"))  # so no name can clash
    joined = rows.join(chosen, "doc_id")
    again = joined.where("copies > 1").dropDuplicates(["doc_id"])
    return joined.where("copies = 1").unionByName(again).select("row.*").unionByName(docs.where("doc_id IS NULL"))


def op9_simhash_near_dedup(docs: DataFrame, **options) -> DataFrame:
    return near_duplicates(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
