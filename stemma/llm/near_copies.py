"""Near copies of the pipeline's stage: five-word shingle sets with a Jaccard similarity of 0.8 or more.

Words and case follow the fingerprints of ``simhash``. Equal sets are one row. Candidates are first
the sets that ``simhash``'s covering tables connect: fingerprints within its radius, directly or
through others, are one bucket. A pair at 0.8 may differ in more bits than that, so min-hash bands
add buckets: ``BANDS`` bands of ``ROWS`` minima each, so a pair at exactly 0.8 shares no band
with a chance of (1 - 0.8^4)^20, under 3 in 100,000, and closer pairs less often. Every candidate is
verified on the whole shingle sets.

Documents that share a bucket, directly or through others, form a candidate group, and each
document's shingle set moves once, to its group's task. Inside it nothing is paired: the task floods
from member to member and sends one edge a member. A group over ``block_rows`` is taken bucket by
bucket instead (those with the same members once), and a bucket over it is dealt to pairs of blocks,
so a task holds two blocks at most and every pair of a bucket's members still meets.

Defined cases: null and empty texts, and texts without words, have the same empty set and are
copies of each other; fewer than 5 words give one shingle of them all; texts of any length count
with their whole set; rows that repeat a text or a doc_id are copies; rows without a doc_id stay;
an empty table gives no rows. Extra columns of any name are kept by ``keep_one_similar``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, alone, drop_table, persist_table
from .simhash import _LOWER, components, fingerprint, first_of_each, near_links

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 20, 4, 42
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w, SEED) for w in (text or "").encode().translate(_LOWER).split()], np.uint64)
    if not len(words):
        return words
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    made = np.full(n, width, np.uint64)
    for k in range(width):
        made = made * _P + words[k : k + n]
    return np.unique(_mix(made))


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
    return draw() | np.uint64(1), draw()


def bands(found: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One hash a band, over its number and its minima."""
    if not len(found):
        return np.empty(0, np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 512):
        np.minimum(low, _mix(found[at : at + 512, None] * family[0] + family[1]).min(0), out=low)
    low = low.reshape(BANDS, ROWS)
    made = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        made = made * _P + low[:, k]
    return _mix(made)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate([*rows, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=kind)


def _keys(found: list[np.ndarray]) -> pa.Array:
    import xxhash

    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the shingle set), fp (SimHash fingerprint), bands."""
    schema = "doc_id long, key long, fp long, bands array<long>"
    out = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [shingles(t) for t in texts]
            fps = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), _keys(found), fps, _lists([bands(s, family) for s in found], out.field(3).type)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(alone(run), schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """key, shingles: made anew for the few documents that have candidates, so that no table holds every document's."""
    schema = "key long, shingles array<long>"
    out = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_keys(found), _lists(found, out.field(1).type)], schema=out)

    return docs.select("text").mapInArrow(alone(run), schema)


def link_similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The representative (smallest index) of each set's connected part, flooding as ``simhash.link_sets`` does."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(values), np.int64)
    label = np.full(n, -1, np.int64)
    rest = np.arange(n)
    while len(rest):
        root, rest = rest[0], rest[1:]
        label[root] = root
        frontier = [root]
        while frontier and len(rest):
            at = frontier.pop()
            fit = rest[np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at]) - 1e-9]
            if not len(fit):
                continue
            own = flat[starts[at] : starts[at + 1]]
            mark[own] = 1
            first = np.concatenate([[0], np.cumsum(sizes[fit])])
            taken = np.arange(first[-1]) + np.repeat(starts[fit] - first[:-1], sizes[fit])
            common = np.add.reduceat(mark[flat[taken]], first[:-1])
            mark[own] = 0
            near = fit[common >= similarity * (sizes[fit] + sizes[at] - common) - 1e-9]
            label[near] = root
            frontier.extend(near.tolist())
            rest = rest[label[rest] < 0]
    return label


def fingerprint_buckets(marked: DataFrame) -> DataFrame:
    """key, bucket of ``sketches``: sets whose fingerprints ``simhash`` connects share a bucket."""
    pairs = marked.select("key", "fp").distinct()
    roots = components(near_links(pairs.select("fp").distinct()))
    return pairs.join(roots, "fp", "left").select("key", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("bucket")).distinct()


def similar_links(docs: DataFrame, marked: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Edges (a, b) between keys that connect all candidates of ``sketches`` with similar sets."""
    distinct = persist_table(marked.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "distinct")
    keyed = persist_table(distinct.select("key", F.explode("bands").alias("bucket")).unionByName(fingerprint_buckets(marked)), "keyed")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.bit_xor(F.xxhash64("key")).alias("members")).where("n > 1")
    buckets = persist_table(sizes.groupBy("n", "low", "members").agg(F.min("bucket").alias("bucket")), "buckets")
    met = persist_table(keyed.join(buckets.select("bucket", "n", "low"), "bucket"), "members")
    groups = components(stars(met.select(F.col("low").alias("a"), F.col("key").alias("b"))), "key")
    large = groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("root")
    none = F.lit(0)
    by_group = groups.join(large, "root", "left_anti").select("key", F.col("root").alias("g"), none.alias("i"), none.alias("j"))
    mine = F.pmod(F.xxhash64("key", F.lit(7)), F.ceil(F.col("n") / block_rows)).cast("int")
    crowd = met.join(groups.join(large, "root", "left_semi").select("key"), "key", "left_semi")
    crowd = crowd.select("key", F.col("bucket").alias("g"), mine.alias("mine"), F.explode(F.sequence(none, F.ceil(F.col("n") / block_rows).cast("int") - 1)).alias("other"))
    routed = by_group.unionByName(crowd.select("key", "g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))
    need = distinct.select("key", "doc_id").join(groups.select("key"), "key", "left_semi").select("doc_id").distinct()
    sets = shingle_sets(docs.join(need, docs["doc_id"].eqNullSafe(need["doc_id"]), "left_semi")).dropDuplicates(["key"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        keys = pdf["key"].to_numpy()
        root = keys[link_similar([np.asarray(s) for s in pdf["shingles"]])]
        moved = root != keys
        return pd.DataFrame({"a": root[moved], "b": keys[moved]})

    links = persist_table(routed.join(sets, "key").groupBy("g", "i", "j").applyInPandas(join, "a long, b long"), "links")
    for table in (distinct, keyed, buckets, met):
        drop_table(table)
    return stars(links)


def stars(edges: DataFrame) -> DataFrame:
    """Edges that connect what (a, b), a <= b, connect: each b to its least a, and that one to b's others.

    A b has an a for each of its bands, and, where its bucket is cut, for each pair of blocks; many
    share theirs, so about one edge a node is left.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("least"), F.collect_set("a").alias("each"))
    pairs = least.select(F.col("least").alias("a"), F.explode(F.array_union("each", F.array("b"))).alias("b"))
    return pairs.where("a <> b").distinct()


def similar_groups(docs: DataFrame, block_rows: int = 1024) -> DataFrame:
    """doc_id, key, component_id."""
    marked = persist_table(sketches(docs), "sketches")
    distinct = marked.groupBy("key").agg(F.min("doc_id").alias("least"))
    roots = components(similar_links(docs, marked, block_rows), "key")
    grouped = distinct.join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    first = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(first, "root").select("key", "component_id")
    return marked.select("doc_id", "key").join(named, "key").select("doc_id", "key", "component_id")


def keep_one_similar(docs: DataFrame, block_rows: int = 1024) -> DataFrame:
    """``simhash.keep_one`` by shingle similarity instead of fingerprints."""
    return first_of_each(docs, similar_groups(docs, block_rows))
