"""The extraction life cycle on its versioned log: conflicts, lost owners, killed writers, random histories."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stemma.operators.runs import ExtractionRuns
from stemma.plans.snapshots import Change, Conflict, SnapshotLog

STREAM = {"schema_version_id": 1, "engine": "mock", "model": "m", "prompt_version": "p1", "decode_params": "{}"}


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def chunk_frame(spark, docs):
    """docs: {doc_id: [chunk texts]}"""
    rows = [(d, "sha256:" + hashlib.sha256("|".join(texts).encode()).hexdigest(), i, 10 * i, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, content_hash string, chunk int, char_offset int, text string")


def texts_of(spark, docs):
    rows = {("sha256:" + hashlib.sha256(t.encode()).hexdigest(), t) for texts in docs.values() for t in texts}
    return spark.createDataFrame(sorted(rows), "content_hash string, text string")


def extractor(bad=()):
    """One entity a chunk, named by its text; texts in ``bad`` fail."""

    def extract(chunks):
        row = F.struct(F.lit("entity").alias("kind"), F.col("text").alias("name"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("{}").alias("properties"))
        fails = F.col("text").isin(list(bad)) if bad else F.lit(False)
        return chunks.select("run_id", "chunk", F.when(fails, "timeout").alias("error_kind"), F.lit('{"n": 1}').alias("stats"), F.when(fails, F.array().cast("array<struct<kind:string,name:string,start:int,end:int,properties:string>>")).otherwise(F.array(row)).alias("rows"))

    return extract


DOCS = {"a": ["one", "two", "three"], "b": ["four"], "c": ["four"], "d": ["five", "six"]}


def names(x):
    return sorted(r["name"] for r in x.proposals().collect())


def states(x):
    return {r["doc_id"]: r["status"] for r in x.run_states().collect()}


def test_plan_is_idempotent_and_shares_equal_contents(spark, tmp_path):
    x = ExtractionRuns(spark, str(tmp_path / "runs"))
    for _ in range(2):
        x.plan(chunk_frame(spark, DOCS), **STREAM)
    runs = {r["doc_id"]: r for r in x.run_states().collect()}
    assert sorted(runs) == ["a", "b", "d"] and {r["status"] for r in runs.values()} == {"pending"}
    pieces = b"".join(b"%d:%d:" % (i, 10 * i) + hashlib.sha256(t.encode()).digest() for i, t in enumerate(DOCS["a"]))
    assert runs["a"]["plan_hash"] == "sha256:" + hashlib.sha256(pieces).hexdigest()
    x.plan(chunk_frame(spark, {"a": ["one", "two", "three"]}), **STREAM | {"prompt_version": "p2"})
    assert x.run_states().count() == 4 and x.chunk_states().count() == 9


def test_failures_are_taken_up_again(spark, tmp_path):
    x, texts = ExtractionRuns(spark, str(tmp_path / "runs")), texts_of(spark, DOCS)
    x.plan(chunk_frame(spark, DOCS), **STREAM)
    assert x.work(texts, extractor(["two"])) == {"succeeded": 5, "failed": 1, "lost": 0}
    assert states(x) == {"a": "failed", "b": "complete", "d": "complete"} and names(x) == ["five", "four", "one", "six", "three"]
    assert [(r["chunk"], r["error_kind"], r["attempts"]) for r in x.chunk_states().where("status = 'failed'").collect()] == [(1, "timeout", 1)]
    assert x.work(texts, extractor()) == {"succeeded": 1, "failed": 0, "lost": 0}
    assert states(x)["a"] == "complete" and names(x) == ["five", "four", "one", "six", "three", "two"]
    assert x.work(texts, extractor()) == {"succeeded": 0, "failed": 0, "lost": 0}


def test_a_killed_owner_is_replaced(spark, tmp_path):
    clock, path = Clock(), str(tmp_path / "runs")
    a, b = (ExtractionRuns(spark, path, owner, lease=60, clock=clock) for owner in ("a", "b"))
    a.plan(chunk_frame(spark, DOCS), **STREAM)
    claimed = a.claim().join(texts_of(spark, DOCS), "content_hash")
    first = claimed.where("text IN ('one', 'four')")
    a.record(extractor()(first))
    a.log.write_part(extractor()(claimed))  # killed before its manifest
    assert b.claim().count() == 0 and b.recover() == {"runs": 0, "chunks": 0}
    clock.now += 61
    assert b.recover() == {"runs": 3, "chunks": 4}
    assert b.work(texts_of(spark, DOCS), extractor()) == {"succeeded": 4, "failed": 0, "lost": 0}
    assert names(b) == sorted(["one", "two", "three", "four", "five", "six"]) and set(states(b).values()) == {"complete"}
    late = a.record(extractor()(claimed))  # it wasn't dead after all
    assert late == {"succeeded": 0, "failed": 0, "lost": 6} and len(names(b)) == 6
    assert a.finish() and set(states(a).values()) == {"complete"}


def test_cancelled_and_compacted(spark, tmp_path):
    x = ExtractionRuns(spark, str(tmp_path / "runs"))
    x.plan(chunk_frame(spark, DOCS), **STREAM)
    claimed = x.claim(limit=2)
    assert claimed.select("run_id").distinct().count() == 2
    x.finish(cancelled=True)
    before = sorted(map(str, x.chunk_states().collect()))
    assert Counter(states(x).values()) == {"cancelled": 2, "pending": 1}
    x.compact()
    assert sorted(map(str, x.chunk_states().collect())) == before and x.claim().count() > 0


def test_random_histories_keep_every_chunk_once(spark, tmp_path):
    """Owners claim, record, die, recover and finish in any order; each chunk's rows come once."""
    for seed in (1,):
        rng, clock, path = random.Random(seed), Clock(), str(tmp_path / f"runs{seed}")
        docs = {f"d{i}": [f"{i}-{j}" for j in range(rng.randint(1, 3))] for i in range(4)}
        texts = texts_of(spark, docs)
        owners = [ExtractionRuns(spark, path, f"o{i}", lease=30, clock=clock) for i in range(3)]
        held = {}
        owners[0].plan(chunk_frame(spark, docs), **STREAM)
        for _ in range(10):
            x, act = rng.choice(owners), rng.choice(["claim", "record", "record", "finish", "recover", "wait"])
            if act == "claim":
                held[x.owner] = x.claim(limit=rng.choice([1, 2, None])).join(texts, "content_hash")
            elif act == "record" and x.owner in held:
                some = held[x.owner].where(F.pmod(F.xxhash64("text", F.lit(rng.random())), F.lit(2)) == 0)
                x.record(extractor([t for ts in docs.values() for t in ts if rng.random() < 0.2])(some))
            elif act == "finish":
                x.finish()
            elif act == "recover":
                x.recover()
            else:
                clock.now += 20
            got = names(x)
            assert len(got) == len(set(got))
            assert got == sorted(r["name"] for r in x.proposals().join(x.chunk_states().where("status = 'succeeded'"), ["run_id", "chunk"], "left_semi").collect())
        clock.now += 100
        last = ExtractionRuns(spark, path, "last", clock=clock)
        last.recover()
        last.work(texts, extractor())
        assert names(last) == sorted(t for ts in docs.values() for t in ts) and set(states(last).values()) == {"complete"}


def test_two_writers_one_retries(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"), {"t": "k int, v string"})
    one = lambda k: spark.createDataFrame([(k, "x")], "k int, v string")
    assert log.version() == 0 and log.read("t").count() == 0
    base = log.version()
    assert log.commit(base, Change({"t": one(1)})) == 1
    with pytest.raises(Conflict):
        log.commit(base, Change({"t": one(2)}))
    tries = []

    def change(b):
        tries.append(b)
        if len(tries) == 1:
            log.commit(b, Change({"t": one(3)}))  # another writer comes first
        return Change({"t": one(4)})

    assert log.update(change) == 3 and tries == [1, 2]
    assert sorted(r["k"] for r in log.read("t").collect()) == [1, 3, 4]
    assert sorted(r["k"] for r in log.read("t", 1).collect()) == [1]  # an old reader sees its own version


def test_columns_grow_and_parts_go(spark, tmp_path):
    path = str(tmp_path / "log")
    SnapshotLog(spark, path, {"t": "k int"}).update(lambda b: Change({"t": spark.createDataFrame([(1,)], "k int")}))
    log = SnapshotLog(spark, path, {"t": "k int, status string, w double"}, {"t.status": "'proposed'"})
    log.update(lambda b: Change({"t": spark.createDataFrame([(2, "verified", 0.5)], "k int, status string, w double")}))
    want = [(1, "proposed", None), (2, "verified", 0.5)]
    assert sorted(map(tuple, log.read("t").collect())) == want
    v = log.compact("t")
    assert sorted(map(tuple, log.read("t").collect())) == want and len(log.manifest()["tables"]["t"]) == 1
    assert len(log.forget(v)) == 2 and sorted(map(tuple, log.read("t").collect())) == want
    with pytest.raises(ValueError):
        log.commit(v, Change({"t": spark.createDataFrame([(1,)], "other int")}))


def test_texts_are_chunked_and_dealt_once(spark):
    """The plan's chunks are made without a join of texts, whose second reading and shuffle were most of the time."""
    from stemma.plans import queries_runs

    from .conftest import DATA

    made = queries_runs._chunks(spark, DATA)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL")
    assert {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "'sha256:' || sha2(text, 256) AS h").collect()} == {r["doc_id"]: r["content_hash"] for r in made.collect()}
