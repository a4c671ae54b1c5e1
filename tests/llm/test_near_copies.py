"""The pipeline's near copies against every pair of documents."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import near_copies, simhash


def sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def corpus():
    """Near copies whose fingerprints mostly differ in more than 4 bits, chains of them, near misses and odd rows."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [None, "", "one two", "One  two", "one three"]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([30, 60, 150, 400]))
        rows.append(" ".join(base))
        for _ in range(4):
            base = list(base)
            for _ in range(max(1, len(base) // rng.choice([40, 60, 200]))):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append(" ".join(base))
    return rows


def kept_by_pairs(rows):
    found = [sets(t) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    wide = 0
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if alike(found[a], found[b]):
                wide += bin(simhash.fingerprint(rows[a]) ^ simhash.fingerprint(rows[b])).count("1") > simhash.RADIUS
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert wide > 10
    return sorted({find(k) for k in range(len(rows))})


def test_stage_follows_shingle_similarity(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = kept_by_pairs(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    assert sorted(r["doc_id"] for r in near_copies.keep_one_similar(docs, block_rows=2).collect()) == want


def test_flood_meets_every_pair():
    rows = [near_copies.shingles(t) for t in corpus() if t]
    label = near_copies.link_similar(rows)
    for a in range(len(rows)):
        for b in range(a):
            if len(np.intersect1d(rows[a], rows[b])) >= 0.8 * len(np.union1d(rows[a], rows[b])) - 1e-9:
                assert label[a] == label[b]


def test_fingerprints_bring_candidates(spark):
    """Without a shared band, SimHash's links alone connect sets that are similar."""
    rng = random.Random(5)
    words = [rng.choice([f"w{i}" for i in range(3000)]) for _ in range(400)]
    far = " ".join(rng.choices(words, k=400))
    near = next(t for i in range(400) if simhash.fingerprint(t := " ".join([*words[:i], "other", *words[i + 1 :]])) != simhash.fingerprint(" ".join(words)) and (simhash.fingerprint(t) ^ simhash.fingerprint(" ".join(words))).bit_count() <= 4)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, far)], "doc_id long, text string")
    marked = near_copies.sketches(docs).withColumn("bands", F.array("key"))
    keys = {r["doc_id"]: r["key"] for r in marked.collect()}
    assert [{r["a"], r["b"]} for r in near_copies.similar_links(docs, marked).collect()] == [{keys[1], keys[2]}]
