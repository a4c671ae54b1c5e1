"""Rows without a doc_id, trees walked node by node, very long texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import decontaminate, packing, quality_rules, simhash, suffix_dedup, token_binary, tokens

LONG = "alpha beta gamma delta epsilon " * 60_000
ROWS = [(None, "a passage of words that is long enough to count as a repeat of fifty bytes"), (None, "a passage of words that is long enough to count as a repeat of fifty bytes"), (4, "x a passage of words that is long enough to count as a repeat of fifty bytes"), (5, None), (6, ""), (7, LONG), (8, "short")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in ROWS], "doc_id long, text string, part string, rank string").repartition(3)


def test_trees_node_by_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    trees = quality_rules.fit_trees(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=12)
    for row, got in zip(x[:50], trees.margin(x[:50])):
        total = trees.base
        for at in trees.roots.tolist():
            while trees.left[at] != at:
                at = int(trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at])
            total += trees.value[at]
        assert got == pytest.approx(total)


def test_rules(spark, docs):
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    rows = quality_rules.op1_quality_rules(docs, labels).collect()
    assert len(rows) == len(ROWS) and sum(r["doc_id"] is None for r in rows) == 2
    assert next(r for r in rows if r["doc_id"] == 7)["n_words"] == 300_000


def test_tokens_and_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in ROWS if k is not None}
    got = {r["doc_id"]: r for r in token_binary.op5_token_binary(docs).where("doc_id IS NOT NULL").collect()}
    for k, some in ids.items():
        assert (got[k]["n_tokens"], got[k]["ids_crc32"]) == (len(some) + 1, zlib.crc32(np.array([*some, 0], "<u4").tobytes()))
    pieces = packing.op7_best_fit_packing(docs).toPandas()
    assert pieces.doc_id.isna().sum() == 2 and (pieces[pieces.doc_id == 7].length.sum()) == len(ids[7]) + 1
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_repeats_and_groups(docs):
    rows = suffix_dedup.op6_suffix_array_dedup(docs).collect()
    removed = {r["doc_id"]: r["n_removed"] for r in rows}
    assert removed[4] == 0 and removed[7] == 0 and [r["n_removed"] for r in rows if r["doc_id"] is None] == [len(ROWS[0][1])] * 2
    groups = simhash.op9_simhash_near_dedup(docs).collect()
    assert len(groups) == len(ROWS) and all(r["component_id"] is not None for r in groups if r["doc_id"] is not None)
    assert simhash.keep_one(docs).where("doc_id IS NULL").count() == 2


def test_decontamination(spark, docs):
    items = spark.createDataFrame([("k", "alpha beta gamma delta epsilon alpha beta gamma delta epsilon"), (None, "no words here that occur")], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontaminate.op8_benchmark_decontamination(docs, items).where("doc_id IS NOT NULL").collect()}
    assert rows[7]["n_hit"] == 300_000 and rows[8]["n_hit"] == 0
    assert decontaminate.remove_contamination(docs, items).where(F.col("doc_id").isNull()).count() == 2
