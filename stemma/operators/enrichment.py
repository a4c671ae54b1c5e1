"""Looking verified nodes up in curated resources: a pass over stored answers, the queue of what matched, decisions, registry hints.

Annotations have one row a (node_id, resource): external_id, record_url, matched_name, facts (a map),
status (proposed, verified, rejected), created_ts, decided_ts, decided_by, decision_note. What people
decided is never overwritten; a proposed row is refreshed by a later answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_symbol

ANNOTATIONS = "node_id string, resource string, external_id string, record_url string, matched_name string, facts map<string,string>, status string, created_ts double, decided_ts double, decided_by string, decision_note string"
#: Fixed value: the resources and the order in which a pass asks them.
RESOURCE_ORDER = ("uniprot", "mygene", "ensembl", "chembl")
RECORD = ["external_id", "record_url", "matched_name", "facts"]
KEYS = ["node_id", "resource"]


def enrich(nodes: DataFrame, annotations: DataFrame, answers: DataFrame, now: float, resources: list[str] | None = None, limit: int | None = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations after the pass, its report of one row, failures as (resource, name, error)).

    The ``limit`` oldest verified nodes (all where it is None; by verified_ts, else created_ts, ties by
    id) meet each resource; pairs that people decided, then names that aren't shaped like a
    symbol, are skipped. ``answers`` (resource, name, ``RECORD``, error) are what the resources said:
    an error is a failure of that pair alone, no answer or one without external_id is a miss. Of
    several answers to one question those without error come first, then the least external_id.

    Report: nodes_considered, skipped_decided, skipped_shape, lookups, failed, missed, matched,
    proposed (new rows) and refreshed (rows that were waiting already).
    """
    resources = list(resources or RESOURCE_ORDER)
    unknown = sorted(set(resources) - set(RESOURCE_ORDER))
    if unknown:
        raise ValueError(f"unknown resources: {unknown}")
    age = F.coalesce("verified_ts", "created_ts") if "verified_ts" in nodes.columns else F.col("created_ts")
    work = nodes.where("status = 'verified'")
    work = work if limit is None else work.orderBy(age, "id").limit(limit)
    pairs = work.select(F.col("id").alias("node_id"), "name", F.explode(F.array(*[F.lit(r) for r in resources])).alias("resource"))
    known = annotations.select(*KEYS, F.col("status").alias("was"))
    rank = F.struct(F.col("error").isNotNull(), F.col("external_id").isNull(), F.coalesce("external_id", F.lit("")), F.coalesce("record_url", F.lit("")))
    one = answers.groupBy("resource", "name").agg(F.min_by(F.struct(*RECORD, "error"), rank).alias("said"))
    met = pairs.join(known, KEYS, "left").join(one, ["resource", "name"], "left")
    state = (
        F.when(F.col("was").isNotNull() & (F.col("was") != "proposed"), "skipped_decided")
        .when(~F.coalesce(looks_like_symbol(F.col("name")), F.lit(False)), "skipped_shape")
        .when(F.col("said.error").isNotNull(), "failed")
        .when(F.col("said.external_id").isNull(), "missed")
        .when(F.col("was").isNull(), "proposed")
        .otherwise("refreshed")
    )
    told = met.select(*KEYS, "name", "said", state.alias("state"))
    number = lambda *states: F.count_if(F.col("state").isin(*states))
    asked = ("failed", "missed", "proposed", "refreshed")
    report = told.agg(
        F.count_if(F.col("resource") == resources[0]).alias("nodes_considered"),
        number("skipped_decided").alias("skipped_decided"),
        number("skipped_shape").alias("skipped_shape"),
        number(*asked).alias("lookups"),
        number("failed").alias("failed"),
        number("missed").alias("missed"),
        number("proposed", "refreshed").alias("matched"),
        number("proposed").alias("proposed"),
        number("refreshed").alias("refreshed"),
    )
    fresh = told.where(F.col("state").isin("proposed", "refreshed")).select(*KEYS, "said", F.lit(1).alias("fresh"))
    both = annotations.join(fresh, KEYS, "full_outer")
    new = F.col("fresh").isNotNull()
    record = [F.when(new, F.col(f"said.{c}")).otherwise(F.col(c)).alias(c) for c in RECORD]
    after = both.select(*KEYS, *record, F.coalesce("status", F.lit("proposed")).alias("status"), F.when(new, F.lit(float(now))).otherwise(F.col("created_ts")).alias("created_ts"), "decided_ts", "decided_by", "decision_note")
    return after, report, told.where("state = 'failed'").select("resource", "name", F.col("said.error").alias("error"))


def pending_annotations(annotations: DataFrame, nodes: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest proposed annotations with the node's own name, type and status, which a reviewer compares."""
    named = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), F.col("entity_type").alias("node_type"), F.col("status").alias("node_status"))
    return annotations.where("status = 'proposed'").join(named, "node_id").orderBy("created_ts", *KEYS).limit(limit)


def decide(annotations: DataFrame, nodes: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations, nodes) after ``decisions``: node_id, resource, accept, by, note, ts.

    Only proposed annotations are decided, each by its earliest decision (ties: a rejection).
    An accepted one puts its record, as JSON, under its resource's key of the node's properties;
    facts win over fields of their name. Decisions on anything else change nothing.
    """
    first = decisions.groupBy(*KEYS).agg(F.min_by(F.struct("accept", "by", "note", "ts"), F.struct("ts", "accept", "by")).alias("d"))
    met = annotations.join(first, KEYS, "left").withColumn("now", (F.col("status") == "proposed") & F.col("d").isNotNull())
    turned = met.select(
        *KEYS,
        *RECORD,
        F.when(F.col("now"), F.when(F.col("d.accept"), "verified").otherwise("rejected")).otherwise(F.col("status")).alias("status"),
        "created_ts",
        F.when(F.col("now"), F.col("d.ts")).otherwise(F.col("decided_ts")).alias("decided_ts"),
        F.when(F.col("now"), F.col("d.by")).otherwise(F.col("decided_by")).alias("decided_by"),
        F.when(F.col("now"), F.col("d.note")).otherwise(F.col("decision_note")).alias("decision_note"),
    )
    empty = F.create_map().cast("map<string,string>")
    facts = F.coalesce("facts", empty)
    fields = F.create_map(*[x for c in RECORD[:3] for x in (F.lit(c), F.col(c))])
    whole = F.map_concat(F.map_filter(fields, lambda k, _: ~F.map_contains_key(facts, k)), facts)
    said = met.where(F.col("now") & F.col("d.accept")).groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("resource", F.to_json(whole).alias("json"))))).alias("_facts"))  # a row a resource
    had = F.coalesce("properties", empty)
    merged = F.map_concat(F.map_filter(had, lambda k, _: ~F.map_contains_key("_facts", k)), F.col("_facts"))
    held = nodes.join(said, "id", "left").withColumn("properties", F.when(F.col("_facts").isNotNull(), merged).otherwise(F.col("properties")))
    return turned, held.select(*nodes.columns)


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """One row: proposed, verified, rejected."""
    return annotations.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("proposed", "verified", "rejected")])


def upsert_hints(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (node_id, registry) of hints with fetched_ts: the last one given replaces the others.

    Rows of ``new`` replace those of ``old``; among several of ``new`` the latest stays (ties: the least accession).
    """
    rest = [c for c in old.columns if c not in ("node_id", "registry")]
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_turn", F.lit(1)))
    last = F.min_by(F.struct(*rest), F.struct(-F.col("_turn"), F.coalesce(-F.col("fetched_ts"), F.lit(float("inf"))), F.coalesce("accession", F.lit(""))))
    return both.groupBy("node_id", "registry").agg(last.alias("h")).select("node_id", "registry", "h.*").select(*old.columns)


def list_hints(hints: DataFrame, node_id: str) -> DataFrame:
    """A node's hints, the newest first, ties by registry."""
    return hints.where(F.col("node_id") == node_id).orderBy(F.desc("fetched_ts"), "registry")
