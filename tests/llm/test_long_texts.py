"""Language margins don't fall with the length of a text."""

from __future__ import annotations

import random

from stemma.llm import compression


def language(seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(6000)]


def prose(words: list[str], seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices(words, k=n))


def test_long_document_keeps_its_language(spark):
    one, two = language(1), language(2)
    dictionaries = {"one": prose(one, 3, 30_000).encode(), "two": prose(two, 4, 30_000).encode()}
    docs = spark.createDataFrame([(1, prose(one, 5, 500)), (2, prose(one, 6, 600_000)), (3, prose(two, 7, 600_000))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in compression.predict_language(docs, dictionaries, full_margin=1.0).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3)] == ["one", "one", "two"]
    assert not any(r["lang_rejected"] for r in rows.values())
    assert min(rows[k]["lang_score"] for k in (2, 3)) > rows[1]["lang_score"] / 2
