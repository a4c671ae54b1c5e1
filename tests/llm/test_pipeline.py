"""The pipeline's stages on a small corpus with planted cases, each against what it must do."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from stemma.llm import decontaminate, secret_scan, simhash

SYLLABLES = {"en": ["the", "of", "and", "ing", "with", "tion"], "fr": ["les", "des", "être", "eau", "oui", "que"]}


def text(lang: str, seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    item = text("en", 7777, 15)
    rows = [(i, text(lang := ("en", "fr")[i % 2], i), lang, "s") for i in range(40)]
    rows += [(40, rows[3][1], "fr", "s"), (41, rows[4][1] + " end", "en", "s"), (42, "123 456", "en", "s"), (43, None, "en", "s"), (44, text("en", 44) + " " + item, "en", "s"), (45, item, "en", "s"), (46, text("en", 46) + ' token = "0123456789abcdef0123456789abcdef"', "en", "s")]
    spark.createDataFrame([(k, t, lang, s, len(t or "")) for k, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    said = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from stemma.llm.common import persist_table

        before = {r["doc_id"]: r["text"] for r in said.collect()}
        said = persist_table(stage(spark, said, folder), name)
        assert said.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in said.collect()}
        assert set(kept[name]) <= set(before)
    assert {42, 43}.isdisjoint(kept["language_id"]) and set(range(40)) <= set(kept["language_id"])
    after = kept["near_dedup"]
    assert 40 not in after and 3 in after
    fps = {k: simhash.fingerprint(t) for k, t in after.items()}
    assert all(bin(fps[a] ^ fps[b]).count("1") > 4 for a in fps for b in fps if a < b)
    clean = kept["benchmark_decontamination"]
    auto = decontaminate.SuffixAutomaton([(1, decontaminate.normal_words(text("en", 7777, 15)))])
    assert 45 not in clean and 44 in clean and all(not auto.scan(decontaminate.normal_words(t))[0] for t in clean.values())
    assert all(clean[k] == after[k] for k in clean if k != 44)
    safe = kept["secret_scan"]
    assert set(safe) == set(clean) and "0123456789abcdef" not in safe[46] and not any(secret_scan.secrets(t) for t in safe.values())


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 1024
    assert set(range(40)) <= set(rows.doc_id)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, piece int, component_id long"


def odd_folder(spark, folder, rows):
    spark.createDataFrame([(k, t, lang, None, None, 0.5, 1, 2) for k, t, lang in rows], ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, text("en", 7777, 15)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_an_empty_table_stays_empty(spark, tmp_path):
    folder = odd_folder(spark, tmp_path, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_repeated_null_and_very_long_rows(spark, tmp_path):
    long = text("en", 5, 60_000)
    rows = [(i, text(("en", "fr")[i % 2], i), ("en", "fr")[i % 2]) for i in range(24)]
    rows += [(3, rows[3][1], "fr"), (3, text("en", 90), "en"), (None, text("en", 91), "en"), (None, text("fr", 92), None), (50, long, "en"), (51, None, None), (52, "", "en"), (53, "123 !!!", "en")]
    folder = odd_folder(spark, tmp_path, rows)
    out = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from stemma.llm.common import persist_table

        out = persist_table(stage(spark, out, folder), name)
        assert out.columns == corpus_pipeline.COLUMNS
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    ids = sorted(k for k, _ in kept if k is not None)
    assert ids == [*range(24), 50] and dict(kept)[50] == long  # of the rows of document 3 one stays
    assert sorted(t for k, t in kept if k is None) == sorted([text("en", 91), text("fr", 92)])
    assert all(dict(kept)[k] == t for k, t, _ in rows[:24] if k != 3) and dict(kept)[3] in (rows[3][1], text("en", 90))
    packed = corpus_pipeline.STAGES[-1][1](spark, out, folder).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024 and packed[packed.doc_id == 50].length.sum() > 60_000
