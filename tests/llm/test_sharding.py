"""The external shuffle: whole rows, exact shard laws, repeatable whatever the layout, spread evenly."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stemma.llm import queries, sharding

from ..conftest import DATA

SCHEMA = "doc_id long, text string, shard string, _bucket int, d_text int, `odd name.x` double"
ODD = [(0, None), (1, ""), (2, "a"), (2, "b"), (None, "null id"), (None, "null id"), (5, "ü" * 300_000), (6, "same"), (7, "same"), *((8, "repeat") for _ in range(200))]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, "clash", 1, 2, 0.5) for k, t in rows], SCHEMA).repartition(parts)


def holds(rows, shards):
    """The law ``rows``: counts at most one apart, slots gapless from 0."""
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1


def test_op13_odd_rows(spark):
    got = sharding.op13_external_shuffle(frame(spark, ODD)).collect()
    want = [(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in ODD]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(want)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    holds(got, 24)


@pytest.mark.parametrize("rows", [[], [(1, "x")], [(i, None) for i in range(5)]])
def test_op13_few_rows(spark, rows):
    got = sharding.op13_external_shuffle(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    if rows:
        holds(got, 24)


def test_all_columns_come_back(spark):
    got = sharding.shard_documents(frame(spark, ODD), shards=7)
    assert got.columns == ["doc_id", "text", "_bucket", "d_text", "odd name.x", "shard", "slot"]
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(ODD) and {(r["_bucket"], r["d_text"], r["odd name.x"]) for r in rows} == {(1, 2, 0.5)}
    holds(rows, 7)


def test_layout_does_not_matter_and_seeds_do(spark):
    rows = [(i, f"text {i % 50}") for i in range(500)]
    run = lambda df, seed: sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.op13_external_shuffle(df, seed=seed, buckets=70).collect())
    first = run(frame(spark, rows, 2), 13)
    assert first == run(frame(spark, random.Random(1).sample(rows, 500), 5), 13)
    assert first != run(frame(spark, rows, 2), 14)


def test_one_record_repeated_is_spread_over_buckets(spark):
    rows = [(1, "hot")] * 3000 + [(i, "cold") for i in range(2, 3000)]
    path = sharding.write_shuffled(frame(spark, rows, 4), buckets=64)
    stored = spark.read.parquet(path)
    most = max(r["count"] for r in stored.where("d_text = 'hot'").groupBy("_bucket").count().collect())
    assert most < 3 * 3000 / 64
    places = sorted((r["_bucket"], r["_place"]) for r in stored.collect())
    assert all(p == (0 if i == 0 or places[i - 1][0] != b else places[i - 1][1] + 1) for i, (b, p) in enumerate(places))


def test_starts_by_both_ways(spark, monkeypatch):
    df = frame(spark, [(i, str(i)) for i in range(9000)], 3)
    path = sharding.write_shuffled(df, buckets=5000)  # more than one block of buckets
    starts = sorted(map(tuple, sharding.bucket_starts(spark.read.parquet(path)).collect()))
    counts = Counter(r["_bucket"] for r in spark.read.parquet(path).collect())
    before, want = 0, []
    for b in sorted(counts):
        want.append((b, before, 9000))
        before += counts[b]
    assert starts == want
    small = sorted(map(tuple, sharding.read_shards(spark, path, 24).collect()), key=str)
    monkeypatch.setattr(sharding, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, sharding.read_shards(spark, path, 24).collect()), key=str) == small


def test_order_is_uniform(spark):
    """Ids in order go to shards independently: chi-square of (tenth of the ids, shard) and of neighbours' shards."""
    n, shards = 6000, 10
    got = sharding.op13_external_shuffle(frame(spark, [(i, "same text") for i in range(n)]), shards=shards).collect()
    shard = np.zeros(n, int)
    for r in got:
        shard[r["doc_id"]] = r["shard"]
    for other in (np.arange(n) * 10 // n, np.roll(shard, 1)):
        table = np.zeros((10, shards))
        np.add.at(table, (other, shard), 1)
        chi = ((table - n / 100) ** 2 / (n / 100)).sum()
        assert chi < 150  # 81 degrees of freedom: a chance of under 1 in 10^5


def test_op13_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = queries.queries()["op13_external_shuffle"](spark, DATA).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d["doc_id"], len(d["text"].encode()) + 8, zlib.crc32(d["text"].encode())) for d in docs)
    holds(got, 24)
