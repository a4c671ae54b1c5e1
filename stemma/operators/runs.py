"""The life of extraction runs: planned, claimed by an owner, worked off, finished, recovered.

A run is one document content under one stream (schema, engine, model, prompt, decoding) and one
chunk plan; its id is a hash of these, so planning twice adds nothing. Runs, chunks, events and
proposals are tables of one ``SnapshotLog``. A state is never changed in place: events are appended,
and the state of a chunk or run is its event of the highest version. Proposals and the events that
call their chunks succeeded stand in one commit, so a chunk's rows are there once or not at all.

An owner holds a lease. A commit of results looks at the version it builds on: chunks that are no
longer this owner's are left out and counted as lost. ``recover`` turns running work of owners whose
lease has passed (or who have none) into interrupted work, which the next claim takes up.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshots import Change, SnapshotLog

STREAM = ["schema_version_id", "engine", "model", "prompt_version", "decode_params"]
RETRYABLE = ["pending", "failed", "interrupted"]
SCHEMAS = {
    "runs": "run_id string, doc_id string, content_hash string, schema_version_id long, engine string, model string, prompt_version string, decode_params string, plan_hash string, chunks int, created_ts double",
    "chunks": "run_id string, chunk int, char_offset int, content_hash string",
    "run_events": "run_id string, status string, owner string, ts double, version long",
    "chunk_events": "run_id string, chunk int, status string, owner string, attempts int, error_kind string, stats string, ts double, version long",
    "proposals": "run_id string, chunk int, kind string, name string, start int, end int, properties string",
    "owners": "owner string, expires_ts double, version long",
}
#: Results of working off chunks: one row a chunk; ``error_kind`` is null where it went well.
RESULTS = "run_id string, chunk int, error_kind string, stats string, rows array<struct<kind:string,name:string,start:int,end:int,properties:string>>"


def plan_hash(pieces: Column) -> Column:
    """sha256 over ``index:offset:`` and the text's digest bytes of each chunk, in order; ``pieces``: array of (chunk, char_offset, content_hash)."""
    plain = lambda c: F.hex(F.encode(c.cast("string"), "utf-8"))
    one = F.transform(F.array_sort(pieces), lambda p: F.concat(plain(p["chunk"]), F.lit("3A"), plain(p["char_offset"]), F.lit("3A"), F.substring(p["content_hash"], 8, 64)))
    return F.concat(F.lit("sha256:"), F.sha2(F.unhex(F.array_join(one, "")), 256))


def planned(chunks: DataFrame, stream: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(runs, chunks) of (doc_id, content_hash, chunk, char_offset, text); equal contents share a run."""
    hashed = chunks.select("doc_id", "content_hash", "chunk", "char_offset", F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_hash"))
    doc = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    one = hashed.join(doc, ["content_hash", "doc_id"], "left_semi").select("doc_id", "content_hash", "chunk", "char_offset", "text_hash")
    pieces = F.collect_list(F.struct("chunk", "char_offset", F.col("text_hash").alias("content_hash")))  # one document's chunks
    runs = one.groupBy("content_hash", "doc_id").agg(pieces.alias("pieces"))
    runs = runs.select(F.col("doc_id").cast("string").alias("doc_id"), "content_hash", *(F.lit(stream.get(c)).cast("long" if c == "schema_version_id" else "string").alias(c) for c in STREAM), plan_hash(F.col("pieces")).alias("plan_hash"), F.size("pieces").alias("chunks"), "pieces")
    identity = F.sha2(F.to_json(F.struct("content_hash", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in STREAM), "plan_hash")), 256)
    runs = runs.withColumn("run_id", identity)
    return runs.drop("pieces"), runs.select("run_id", F.inline("pieces"))


class ExtractionRuns:
    """One owner's view of the runs at ``path``."""

    def __init__(self, spark: SparkSession, path: str, owner: str | None = None, lease: float = 600.0, clock: Callable[[], float] = time.time):
        self.log = SnapshotLog(spark, path, SCHEMAS)
        self.owner, self.lease, self.clock = owner or uuid.uuid4().hex, lease, clock

    # States ----------------------------------------------------------------------------------

    def chunk_states(self, version: int | None = None) -> DataFrame:
        """Every chunk with its status, owner, attempts, error_kind and stats."""
        version = self.log.version() if version is None else version
        last = self.log.read("chunk_events", version).groupBy("run_id", "chunk").agg(F.max_by(F.struct("status", "owner", "attempts", "error_kind", "stats", "ts"), "version").alias("e"))
        both = self.log.read("chunks", version).join(last, ["run_id", "chunk"], "left")
        return both.select("run_id", "chunk", "char_offset", "content_hash", F.coalesce("e.status", F.lit("pending")).alias("status"), "e.owner", F.coalesce("e.attempts", F.lit(0)).alias("attempts"), "e.error_kind", "e.stats", "e.ts")

    def run_states(self, version: int | None = None) -> DataFrame:
        version = self.log.version() if version is None else version
        last = self.log.read("run_events", version).groupBy("run_id").agg(F.max_by(F.struct("status", "owner", "ts"), "version").alias("e"))
        return self.log.read("runs", version).join(last, "run_id", "left").select(*(c.split(" ")[0] for c in SCHEMAS["runs"].split(", ")), F.coalesce("e.status", F.lit("pending")).alias("status"), "e.owner", "e.ts")

    def proposals(self, version: int | None = None) -> DataFrame:
        return self.log.read("proposals", version)

    # Transitions -----------------------------------------------------------------------------

    def plan(self, chunks: DataFrame, **stream: object) -> int:
        """Add the runs and chunks that aren't there yet."""

        def change(base: int) -> Change:
            runs, parts = planned(chunks, stream)
            new = runs.join(self.log.read("runs", base).select("run_id"), "run_id", "left_anti")
            return Change({"runs": new.withColumn("created_ts", F.lit(self.clock())), "chunks": parts.join(new.select("run_id"), "run_id", "left_semi")}, note="plan")

        return self.log.update(change)

    def _run_events(self, runs: DataFrame, status: Column | str, owner: str | None, base: int) -> DataFrame:
        status = F.lit(status) if isinstance(status, str) else status
        return runs.select("run_id", status.alias("status"), F.lit(owner).cast("string").alias("owner"), F.lit(self.clock()).alias("ts"), F.lit(base + 1).alias("version"))

    def _chunk_events(self, chunks: DataFrame, status: Column | str, owner: str | None, base: int, attempts: Column | None = None, error: str | None = None, stats: str | None = None) -> DataFrame:
        status = F.lit(status) if isinstance(status, str) else status
        null = F.lit(None).cast("string")
        return chunks.select("run_id", "chunk", status.alias("status"), F.lit(owner).cast("string").alias("owner"), (F.col("attempts") if attempts is None else attempts).alias("attempts"), (F.col(error) if error else null).alias("error_kind"), (F.col(stats) if stats else null).alias("stats"), F.lit(self.clock()).alias("ts"), F.lit(base + 1).alias("version"))

    def _leased(self, base: int) -> DataFrame:
        return self.log.spark.createDataFrame([(self.owner, self.clock() + self.lease, base + 1)], SCHEMAS["owners"])

    def renew(self) -> int:
        return self.log.update(lambda base: Change({"owners": self._leased(base)}, note="lease"))

    def claim(self, limit: int | None = None, runs: DataFrame | None = None) -> DataFrame:
        """Take up to ``limit`` runs that nobody works on (oldest first); the chunks to work off now."""
        taken = None

        def change(base: int) -> Change:
            nonlocal taken
            free = self.run_states(base).where(F.col("status").isin(RETRYABLE))
            free = free if runs is None else free.join(runs.select("run_id"), "run_id", "left_semi")
            mine = free.select("run_id") if limit is None else free.orderBy("created_ts", "run_id").limit(limit).select("run_id")
            work = self.chunk_states(base).where(F.col("status").isin(RETRYABLE)).join(mine, "run_id", "left_semi")
            taken = base + 1
            return Change({"run_events": self._run_events(mine, "running", self.owner, base), "chunk_events": self._chunk_events(work, "running", self.owner, base, F.col("attempts") + 1), "owners": self._leased(base)}, note="claim")

        version = self.log.update(change)
        mine = self.log.read("chunk_events", version).where((F.col("version") == taken) & (F.col("owner") == self.owner)).select("run_id", "chunk", "attempts")
        return mine.join(self.log.read("chunks", version), ["run_id", "chunk"])

    def record(self, results: DataFrame) -> dict[str, int]:
        """Commit what working off chunks gave (``RESULTS``): rows with their success, failures by kind.

        Counts of chunks that succeeded, failed and were lost (not this owner's running chunks any more).
        """
        spark = self.log.spark
        part = self.log.write_part(results)  # worked off once, whatever conflicts follow
        got = spark.read.schema(RESULTS).parquet(f"{self.log.path}/parts/{part['id']}")
        counts: dict[str, int] = {}

        def change(base: int) -> Change:
            mine = self.chunk_states(base).where((F.col("status") == "running") & (F.col("owner") == self.owner)).select("run_id", "chunk", "attempts")
            held = got.dropDuplicates(["run_id", "chunk"]).join(mine, ["run_id", "chunk"])
            good, bad = held.where("error_kind IS NULL"), held.where("error_kind IS NOT NULL")
            n = held.agg(F.count_if(F.col("error_kind").isNull()).alias("succeeded"), F.count_if(F.col("error_kind").isNotNull()).alias("failed")).first()
            counts.update(n.asDict(), lost=got.select("run_id", "chunk").distinct().count() - n["succeeded"] - n["failed"])
            events = self._chunk_events(good, "succeeded", None, base, stats="stats").unionByName(self._chunk_events(bad, "failed", None, base, error="error_kind"))
            return Change({"proposals": good.select("run_id", "chunk", F.inline("rows")), "chunk_events": events}, note="results")

        self.log.update(change)
        return counts

    def finish(self, cancelled: bool = False) -> int:
        """Close this owner's runs by their chunks: failed, interrupted, complete, or cancelled at once."""

        def change(base: int) -> Change:
            mine = self.run_states(base).where((F.col("status") == "running") & (F.col("owner") == self.owner)).select("run_id")
            chunks = self.chunk_states(base).join(mine, "run_id", "left_semi")
            if cancelled:
                open_ = chunks.where("status <> 'succeeded'")
                return Change({"run_events": self._run_events(mine, "cancelled", None, base), "chunk_events": self._chunk_events(open_, "cancelled", None, base)}, note="cancel")
            failed, waiting = F.max((F.col("status") == "failed").cast("int")), F.max(F.col("status").isin("pending", "running", "interrupted").cast("int"))
            closed = mine.join(chunks.groupBy("run_id").agg(failed.alias("f"), waiting.alias("w")), "run_id", "left")
            status = F.when(F.col("f") == 1, "failed").when(F.col("w") == 1, "interrupted").otherwise("complete")
            left = chunks.where((F.col("status") == "running") & (F.col("owner") == self.owner)).join(closed.where("coalesce(f, 0) = 0"), "run_id", "left_semi")
            return Change({"run_events": self._run_events(closed, status, None, base), "chunk_events": self._chunk_events(left, "interrupted", None, base)}, note="finish")

        return self.log.update(change)

    def recover(self) -> dict[str, int]:
        """Interrupt running work whose owner's lease has passed; how many runs and chunks."""
        counts: dict[str, int] = {}

        def change(base: int) -> Change:
            alive = self.log.read("owners", base).groupBy("owner").agg(F.max_by("expires_ts", "version").alias("expires_ts")).where(F.col("expires_ts") > self.clock()).select("owner")
            lost = lambda rows: rows.where("status = 'running'").join(alive, "owner", "left_anti")
            runs, chunks = lost(self.run_states(base)), lost(self.chunk_states(base))
            counts.update(runs=runs.count(), chunks=chunks.count())
            return Change({"run_events": self._run_events(runs, "interrupted", None, base), "chunk_events": self._chunk_events(chunks, "interrupted", None, base)}, note="recover")

        self.log.update(change)
        return counts

    def work(self, texts: DataFrame, extract: Callable[[DataFrame], DataFrame], limit: int | None = None) -> dict[str, int]:
        """Claim, extract, record, finish. ``texts``: content_hash (of the chunk), text; ``extract``: claimed chunks with their text to ``RESULTS``."""
        claimed = self.claim(limit)
        with_text = claimed.join(texts.select("content_hash", "text").dropDuplicates(["content_hash"]), "content_hash", "left")
        counts = self.record(extract(with_text).select(*(c.split(" ")[0] for c in ("run_id", "chunk", "error_kind", "stats", "rows"))))
        self.finish()
        return counts

    def compact(self) -> int:
        """Events before now give way to the last one of each run and chunk."""

        def change(base: int) -> Change:
            last = lambda table, keys: self.log.read(table, base).groupBy(*keys).agg(F.max_by(F.struct("*"), "version").alias("e")).select("e.*")
            return Change(replace={"run_events": last("run_events", ["run_id"]), "chunk_events": last("chunk_events", ["run_id", "chunk"]), "owners": last("owners", ["owner"])}, note="compact")

        return self.log.update(change)
