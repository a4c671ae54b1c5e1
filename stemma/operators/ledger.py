"""Operational tables: chat log, runs, artifacts, annotations, enrichment, provenance costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_symbol


def keep_newest(rows: DataFrame, limit: int, order: list, partition: list[str] | None = None) -> DataFrame:
    """The newest ``limit`` rows, of each partition where one is named."""
    if not partition:
        return rows.orderBy(*order).limit(limit)
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def chat_history(turns: DataFrame, limit: int = 200) -> DataFrame:
    """The newest ``limit`` turns, oldest first in ``pos``."""
    page = keep_newest(turns, limit, [F.desc("conv_id"), F.desc("turn")])
    return page.withColumn("pos", F.row_number().over(Window.orderBy("conv_id", "turn")))  # over ``limit`` rows


def cost_summary(log: DataFrame) -> DataFrame:
    """calls and elapsed by engine."""
    return log.where("engine IS NOT NULL").groupBy("engine").agg(F.count("*").alias("calls"), F.sum("elapsed").alias("elapsed"))


def read_log(spark, path: str) -> DataFrame:
    """A JSON-lines log; bad lines are left out."""
    rows = spark.read.schema("engine string, kind string, elapsed double, ts double, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").drop("_bad")


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (upsert by replacement)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def close_zombies(runs: DataFrame) -> DataFrame:
    """Runs that a restart finds running have failed."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def list_artifacts(artifacts: DataFrame, documents: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first; the document's fields where there is one."""
    rows = artifacts.where(F.col("kind") == kind) if kind else artifacts
    return rows.orderBy(F.desc("created_ts"), F.desc("id")).limit(limit).join(documents.select("doc_id", "source"), "doc_id", "left")


def upsert_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """One a (node, resource): undecided ones are refreshed, decided ones stay."""
    keys = ["node_id", "resource"]
    both = old.select(*keys, F.col("facts").alias("f0"), F.col("status").alias("s0")).join(new.select(*keys, F.col("facts").alias("f1")), keys, "full_outer")
    open_ = F.coalesce(F.col("s0") == "pending", F.lit(True))
    return both.select(*keys, F.when(open_, F.coalesce("f1", "f0")).otherwise(F.col("f0")).alias("facts"), F.coalesce("s0", F.lit("pending")).alias("status"))


def decide_annotations(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Node properties with accepted facts under their resource's key."""
    accepted = annotations.where("status = 'accepted'").groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("resource", "facts"))).alias("facts"))
    merged = F.map_concat(F.map_filter("properties", lambda k, _: ~F.map_contains_key("facts", k)), F.col("facts"))
    return nodes.join(accepted, "id", "left").withColumn("properties", F.when(F.col("facts").isNotNull(), merged).otherwise(F.col("properties"))).drop("facts")


def enrichment_worklist(nodes: DataFrame, annotations: DataFrame, resources: list[str], limit: int = 50) -> DataFrame:
    """id, name, resource still to be looked up: verified symbols, oldest first, decided pairs skipped."""
    work = nodes.where((F.col("status") == "verified") & looks_like_symbol(F.col("name"))).orderBy(F.coalesce("verified_ts", "created_ts") if "verified_ts" in nodes.columns else "created_ts", "id").limit(limit)
    pairs = work.select("id", "name", F.explode(F.array(*[F.lit(r) for r in resources])).alias("resource"))
    decided = annotations.where(F.col("status").isin("accepted", "rejected")).select(F.col("node_id").alias("id"), "resource")
    return pairs.join(decided, ["id", "resource"], "left_anti")


def active_schema(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.desc("is_active"), F.desc("id")).limit(1)


def activate_schema(versions: DataFrame, version_id: int) -> DataFrame:
    return versions.withColumn("is_active", F.col("id") == version_id)


def items_per_schema(versions: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of items by version, newest first; versions without items count zero."""
    n = items.groupBy(F.col("schema_version_id").alias("id")).agg(F.count("*").alias("items"))
    return versions.join(n, "id", "left").fillna({"items": 0}).orderBy(F.desc("id"))


def check_relation_types(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relation types whose domain or range is neither declared nor ``*``."""
    names = entities.select("name")
    open_ = relations.select("name", F.explode(F.array("domain_type", "range_type")).alias("end")).where("end <> '*'")
    return open_.join(names.withColumnRenamed("name", "end"), "end", "left_anti").select("name", "end").distinct()


#: What makes two extraction runs the same one.
RUN_IDENTITY = ["doc_id", "content_hash", "schema_version_id", "engine", "model", "prompt_version", "decode_params"]


def plan_chunks(planned: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks to run: new ones, and known ones that are pending, failed or interrupted.

    A run is known by those of ``RUN_IDENTITY`` that both sides have.
    """
    keys = [*(c for c in RUN_IDENTITY if c in planned.columns and c in known.columns), "chunk"]
    done = known.where("status IN ('succeeded', 'running')").select(*keys)
    return planned.join(done, keys, "left_anti")
