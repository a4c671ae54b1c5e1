"""Bounds: automata block by block, buckets that are dealt again, and columns whose names clash."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pandas as pd

from stemma.llm import compression, decontaminate, secret_scan, simhash


def test_one_automaton_at_a_time(spark):
    rng = random.Random(1)
    items = [(k, " ".join(f"w{rng.randrange(20_000)}" for _ in range(100))) for k in range(400)]
    rows = [(k, f"before {t} after" if k % 2 else "clean words only") for k, t in items[:40]]
    docs, frame = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").cache()
    frame.count()
    peak, found = [], []
    for words in (10_000_000, 5_000):
        tracemalloc.start()
        found.append(sorted(map(tuple, decontaminate.op8_benchmark_decontamination(docs, frame, block_words=words).collect())))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert found[0] == found[1] and sum(r[5] for r in found[0]) == 20
    assert peak[1] < 0.4 * peak[0]  # about 25 blocks against one


def test_a_bucket_that_stays_large(spark):
    rng = np.random.default_rng(3)
    free = rng.permutation(64)[:22]
    fps = np.unique((rng.integers(0, 2, (6000, 22)).astype(np.uint64) << free.astype(np.uint64)).sum(1).astype(np.uint64))
    keep = fps[rng.permutation(len(fps))[:3000]]
    edges = simhash.near_links(spark.createDataFrame(pd.DataFrame({"fp": keep.view(np.int64)})), bucket_rows=200)
    got = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
    ordered = np.sort(keep.view(np.int64))
    label = simhash.link_sets(ordered.view(np.uint64), 4)
    assert [got.get(int(f), int(f)) for f in ordered] == [int(ordered[k]) for k in label]


CLASH = "doc_id long, text string, lang string, n_chars long, n_words string, hits string, item_ids string, longest string, _n string, rest string, lang_pred string, _copies string, part string"


def test_clashing_columns(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(k, t, "en", len(t or ""), *["x"] * 9) for k, t in [(1, "some text " + item + " and then much more of it to read on for a while " * 2), (None, "no key at all"), (2, None), (2, "user=bob password=hunter22")]]
    docs = spark.createDataFrame(rows, CLASH)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = decontaminate.remove_contamination(docs, items)
    assert cut.columns == docs.columns and cut.count() == 4 and not cut.where("text LIKE '%kappa%'").count() and cut.where("hits = 'x' AND rest = 'x'").count() == 4
    found = decontaminate.find_hits(docs, items)
    assert len(set(found.columns)) == len(found.columns) and found.where("doc_id = 1").first()["longest"] == 10
    named = compression.predict_language(docs, {"en": b"some text and then much more", "fr": b"les mots"})
    assert len(set(named.columns)) == len(named.columns) and named.count() == 4
    assert secret_scan.redact_secrets(docs).columns == docs.columns
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 3  # rows that repeat doc_id 2 are one document
