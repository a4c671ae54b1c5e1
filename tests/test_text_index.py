"""The positional index against the scan: words, phrases, inserts, deletes, replaced rows, skipped blocks."""

from __future__ import annotations

import random

import pytest

from stemma.operators import search, text_index
from stemma.operators.text_index import TextIndex, build_index

WORDS = "river stone house green über the of and signal gate lamp".split()
QUERIES = ["river", "the river stone", "über lamp", "green_house", "the_river of", "river_river", "absent", "absent river", "", "the and of"]


def texts(seed: int, n: int, first: int = 0) -> dict[int, str | None]:
    rng = random.Random(seed)
    out: dict[int, str | None] = {first + i: " ".join(rng.choices(WORDS, weights=[9 // (j + 1) + 1 for j in range(len(WORDS))], k=rng.randint(1, 40))) for i in range(n)}
    out[first] = None
    out[first + 1] = ""
    return out


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "id long, text string")


def same(spark, index: TextIndex, rows: dict[int, str | None], queries: list[str]) -> None:
    docs = frame(spark, rows)
    for q in queries:
        want = {r["key"]: r["score"] for r in search.bm25(docs, "id", "text", q).collect()}
        got = {r["key"]: r["score"] for r in index.scores(q).collect()}
        assert got.keys() == want.keys(), q
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want), q
        best = [(r["key"], round(r["score"], 9)) for r in search.top_k(index.scores(q), 5).orderBy("rank").collect()]
        assert [(r["key"], round(r["score"], 9)) for r in index.search(q, 5).orderBy("rank").collect()] == best, q


def test_equals_the_scan_through_inserts_and_deletes(spark, tmp_path):
    rows = texts(1, 120)
    index = build_index(frame(spark, rows), "id", "text", str(tmp_path / "index"))
    same(spark, index, rows, QUERIES)
    new = texts(2, 30, first=100) | {7: "river river river"}
    index.upsert(frame(spark, new), "id", "text")
    rows |= new
    gone = list(range(0, 120, 3))
    old = index.log.version()
    index.delete(spark.createDataFrame([(k,) for k in [*gone, 9999]], "key long"))
    before, rows = rows, {k: v for k, v in rows.items() if k not in gone}
    same(spark, index, rows, ["the river stone", "the_river of"])
    want = {r["key"] for r in search.bm25(frame(spark, before), "id", "text", "river").collect()}
    assert {r["key"] for r in index.scores("river", old).collect()} == want  # a reader keeps its version
    index.compact()
    again = TextIndex(spark, str(tmp_path / "index"), "bigint")
    assert again.blocks == index.blocks and again.log.read("gone").count() == 0
    same(spark, again, rows, ["über lamp", "green_house"])


def test_blocks_that_cannot_win_are_skipped(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = {i: " ".join(rng.choices(["common", "filler", "word"], k=60)) for i in range(3000)}
    for i in range(0, 3000, 300):
        rows[i] = "common common common"
    index = TextIndex(spark, str(tmp_path / "index"), "bigint", blocks=300)
    index.upsert(frame(spark, rows), "id", "text")
    got = [r["key"] for r in index.search("common", 5).orderBy("rank").collect()]
    want = [r["key"] for r in search.top_k(search.bm25(frame(spark, rows), "id", "text", "common"), 5).orderBy("rank").collect()]
    assert got == want and index.scored_blocks < 60
    monkeypatch.setattr(text_index, "MOST_NAMED", 4)
    assert [r["key"] for r in index.search("common", 5).orderBy("rank").collect()] == want


def test_an_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), "bigint")
    assert index.search("river").count() == 0 and index.scores("a_b").count() == 0
    index.upsert(spark.createDataFrame([(1, None)], "id long, text string"), "id", "text")
    assert index.search("river").count() == 0


def test_texts_are_read_once_for_an_index(spark, tmp_path):
    """A pass over the texts is most of the work of an index; postings, rows and totals come from one."""
    from pyspark.sql import functions as F

    rows = texts(3, 50)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    index = build_index(frame(spark, rows).withColumn("text", read("text")), "id", "text", str(tmp_path / "index"))
    assert seen.value == len(rows)
    same(spark, index, rows, ["the river stone"])


def test_grouped_tokens_of_odd_rows():
    import pyarrow as pa

    said = [["b", "a", "b"], [], ["a"] * 3, ["ü", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(said, pa.list_(pa.string()))], names=["key", "t"])
    got = [r for b in text_index.grouped_tokens(iter([batch.slice(1), batch.slice(0, 0), batch.slice(1, 1)])) for r in b.to_pylist()]
    assert [r["key"] for r in got] == [1, 2, 3, 1]
    assert [dict(zip(r["terms"], r["positions"])) for r in got] == [{}, {"a": [0, 1, 2]}, {"ü": [0], "b": [1]}, {}] and [r["dl"] for r in got] == [0, 3, 2, 0]
