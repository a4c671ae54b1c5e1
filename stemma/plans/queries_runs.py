"""Queries over the extraction life cycle: documents planned, an owner lost half-way, another one resuming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.runs import RESULTS, ExtractionRuns, planned
from ..sources.documents import chunk_documents
from . import testbed as tb
from .catalogue import _CHUNKS, query
from .checkpoints import at_end, cut, delete, shared_folder

STREAM = {"schema_version_id": 3, "engine": "rule", "model": "long-words", "prompt_version": "p1", "decode_params": '{"t":0}'}
_WORDS = "[a-z]{9,}"


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks carry their document's hash along, so no text is joined."""
    docs = tb.table(s, d, "documents").where("text IS NOT NULL").select(F.struct("doc_id", content_hash(F.col("text")).alias("content_hash")).alias("doc"), "text")
    return chunk_documents(docs, "doc").select("doc.doc_id", "chunk", "char_offset", "text", "doc.content_hash")


_FIRST = _CHUNKS + ", f AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text), k AS (SELECT doc_id, c.text AS whole, chunk, a, substr(c.text, a + 1, e - a) AS piece FROM c JOIN f USING (doc_id))"


@query(
    "extraction_plan",
    _FIRST + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'sha256:' || sha256(any_value(whole)) AS content_hash, CAST(count(*) AS INTEGER) AS chunks,"
    " 'sha256:' || sha256(unhex(string_agg(hex(chunk || ':' || a || ':') || upper(sha256(piece)), '' ORDER BY chunk))) AS plan_hash FROM k GROUP BY doc_id",
)
def _(s, d):
    runs, _chunks_of = planned(_chunks(s, d), STREAM)
    return runs.select("doc_id", "content_hash", "chunks", "plan_hash")


def _long_words(chunks: DataFrame) -> DataFrame:
    """Each distinct long word is a proposal; chunks whose length is a multiple of five time out the first time but one."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(_WORDS), 0))
    rows = F.transform(words, lambda w: F.struct(F.lit("word").alias("kind"), w.alias("name"), (F.instr("text", w) - 1).alias("start"), (F.instr("text", w) - 1 + F.length(w)).alias("end"), F.lit("{}").alias("properties")))
    fails = (F.length("text") % 5 == 0) & (F.col("attempts") == 2)
    kind = RESULTS.split("rows ")[1]
    return chunks.select("run_id", "chunk", F.when(fails, "timeout").alias("error_kind"), F.when(~fails, F.to_json(F.struct(F.size(words).alias("words")))).alias("stats"), F.when(fails, F.array().cast(kind)).otherwise(rows).alias("rows"))


def _resumed(s: SparkSession, d: str) -> ExtractionRuns:
    """One owner records first chunks alone and is lost; the next one recovers and works off the rest."""
    path = f"{shared_folder(s)}/runs-{uuid.uuid4().hex}"
    at_end(lambda: delete(s, path))
    now = [0.0]
    lost, next_ = (ExtractionRuns(s, path, owner, lease=60.0, clock=lambda: now[0]) for owner in ("lost", "next"))
    chunks = cut(_chunks(s, d))  # read four times below
    lost.plan(chunks, **STREAM)
    texts = cut(chunks.select(content_hash(F.col("text")).alias("content_hash"), "text").dropDuplicates(["content_hash"]))
    claimed = lost.claim()
    lost.record(_long_words(claimed.where("chunk = 0").join(texts, "content_hash")))
    now[0] = 61.0
    next_.recover()
    next_.work(texts, _long_words)
    return next_


_STATE = _FIRST + ", s AS (SELECT *, chunk > 0 AND length(piece) % 5 = 0 AS failed, CASE WHEN chunk = 0 THEN 1 ELSE 2 END AS attempts, CASE WHEN chunk > 0 AND length(piece) % 5 = 0 THEN 0 ELSE len(list_distinct(regexp_extract_all(piece, '" + _WORDS + "'))) END AS proposals FROM k)"


@query(
    "extraction_resume",
    _STATE + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN bool_or(failed) THEN 'failed' ELSE 'complete' END AS status, CAST(count(*) AS INTEGER) AS chunks, CAST(count(*) FILTER (NOT failed) AS BIGINT) AS succeeded, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(proposals) AS BIGINT) AS proposals FROM s GROUP BY doc_id",
)
def _(s, d):
    x = _resumed(s, d)
    by_run = x.chunk_states().groupBy("run_id").agg(F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.sum("attempts").alias("attempts"))
    rows = x.proposals().groupBy("run_id").agg(F.count("*").alias("proposals"))
    return x.run_states().join(by_run, "run_id").join(rows, "run_id", "left").select("doc_id", "status", "chunks", "succeeded", "attempts", F.coalesce("proposals", F.lit(0)).alias("proposals"))


@query(
    "extraction_chunk_states",
    _STATE + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(chunk AS INTEGER) AS chunk, CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS status, attempts, CASE WHEN failed THEN 'timeout' END AS error_kind, CASE WHEN NOT failed THEN '{\"words\":' || proposals || '}' END AS stats FROM s",
)
def _(s, d):
    x = _resumed(s, d)
    return x.chunk_states().join(x.run_states().select("run_id", "doc_id"), "run_id").select("doc_id", "chunk", "status", "attempts", "error_kind", "stats")
