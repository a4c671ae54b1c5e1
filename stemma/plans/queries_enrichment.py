"""Queries over a pass of lookups, its queue, decisions and registry hints; nodes of the graph, answers by their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrichment
from . import testbed as tb
from .catalogue import query
from .testbed import NODES_SQL, with_sql

# Nodes are named by their id, which is shaped like a symbol; every fifth has a word before it.
# By key: remainder 0 of 11 waits in uniprot, 1 was accepted in uniprot, 2 rejected in mygene;
# remainder 0 of 7 fails, 1 has no answer, others match, mygene only where the key is even.
_BASE = (
    with_sql(NODES_SQL)
    + ", n AS (SELECT id, k, status, created_ts, CASE WHEN k % 5 = 0 THEN 'the ' || id ELSE id END AS name FROM kg_nodes),"
    " a AS (SELECT id AS node_id, k, CASE WHEN k % 11 = 2 THEN 'mygene' ELSE 'uniprot' END AS resource, CASE k % 11 WHEN 0 THEN 'proposed' WHEN 1 THEN 'verified' ELSE 'rejected' END AS was FROM n WHERE k % 11 <= 2),"
    " p AS (SELECT n.*, r AS resource FROM n, (SELECT unnest(['uniprot', 'mygene']) AS r) WHERE status = 'verified'),"
    " t AS (SELECT p.*, was, CASE WHEN was IS NOT NULL AND was <> 'proposed' THEN 'skipped_decided' WHEN p.k % 5 = 0 THEN 'skipped_shape' WHEN p.k % 7 = 0 THEN 'failed' WHEN p.k % 7 = 1 OR (p.resource = 'mygene' AND p.k % 2 = 1) THEN 'missed' WHEN was IS NULL THEN 'proposed' ELSE 'refreshed' END AS state"
    " FROM p LEFT JOIN a ON p.id = a.node_id AND p.resource = a.resource),"
    " f AS (SELECT id AS node_id, resource, 'X' || id AS external_id, was FROM t WHERE state IN ('proposed', 'refreshed')),"
    " after AS (SELECT coalesce(a.node_id, f.node_id) AS node_id, coalesce(a.resource, f.resource) AS resource, coalesce(f.external_id, 'old') AS external_id, coalesce(a.was, 'proposed') AS status, CASE WHEN f.node_id IS NOT NULL THEN 9.0::DOUBLE ELSE 1.0::DOUBLE END AS created_ts FROM a FULL JOIN f ON a.node_id = f.node_id AND a.resource = f.resource)"
)


def _pass(s: SparkSession, d: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    k, n = F.col("k"), tb.nodes(s, d)
    n = n.withColumn("name", F.when(k % 5 == 0, F.concat(F.lit("the "), "id")).otherwise(F.col("id"))).withColumn("properties", F.create_map(F.lit("k"), k.cast("string"), F.lit("uniprot"), F.lit("before")))
    none = lambda t: F.lit(None).cast(t)
    was = F.when(k % 11 == 0, "proposed").when(k % 11 == 1, "verified").otherwise("rejected")
    old = n.where(k % 11 <= 2).select(F.col("id").alias("node_id"), F.when(k % 11 == 2, "mygene").otherwise("uniprot").alias("resource"), F.lit("old").alias("external_id"), none("string").alias("record_url"), none("string").alias("matched_name"), F.create_map(F.lit("f"), F.lit("old")).alias("facts"), was.alias("status"), F.lit(1.0).alias("created_ts"), none("double").alias("decided_ts"), none("string").alias("decided_by"), none("string").alias("decision_note"))
    asked = n.where(k % 7 != 1).select("name", "id", "k", F.explode(F.array(F.lit("uniprot"), F.lit("mygene"))).alias("resource"))
    hit = (k % 7 != 0) & ~((F.col("resource") == "mygene") & (k % 2 == 1))
    record = {"external_id": F.concat(F.lit("X"), "id"), "record_url": F.concat(F.lit("https://r.org/"), "id"), "matched_name": F.lower("name")}
    answers = asked.select("resource", "name", *[F.when(hit, c).alias(name) for name, c in record.items()], F.create_map(F.lit("f"), F.col("k").cast("string")).alias("facts"), F.when(k % 7 == 0, "HTTPError").alias("error"))
    return n, enrichment.enrich(n, old, answers, 9.0, ["uniprot", "mygene"], None)


@query(
    "enrichment_report",
    _BASE
    + " SELECT count(*) FILTER (resource = 'uniprot') AS nodes_considered, count(*) FILTER (state = 'skipped_decided') AS skipped_decided, count(*) FILTER (state = 'skipped_shape') AS skipped_shape, count(*) FILTER (state IN ('failed', 'missed', 'proposed', 'refreshed')) AS lookups,"
    " count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'missed') AS missed, count(*) FILTER (state IN ('proposed', 'refreshed')) AS matched, count(*) FILTER (state = 'proposed') AS proposed, count(*) FILTER (state = 'refreshed') AS refreshed FROM t",
)
def _(s, d):
    return _pass(s, d)[1][1]


@query("enrichment_failures", _BASE + " SELECT resource, name, 'HTTPError' AS error FROM t WHERE state = 'failed'")
def _(s, d):
    return _pass(s, d)[1][2]


@query("enrichment_annotations", _BASE + " SELECT * FROM after")
def _(s, d):
    return _pass(s, d)[1][0].select("node_id", "resource", "external_id", "status", "created_ts")


@query("enrichment_counts", _BASE + " SELECT count(*) FILTER (status = 'proposed') AS proposed, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected FROM after")
def _(s, d):
    return enrichment.annotation_counts(_pass(s, d)[1][0])


@query("enrichment_queue", _BASE + " SELECT node_id, resource, n.name AS node_name, n.status AS node_status FROM after JOIN n ON id = node_id WHERE after.status = 'proposed' ORDER BY after.created_ts, node_id, resource LIMIT 100")
def _(s, d):
    n, (after, _, _) = _pass(s, d)
    return enrichment.pending_annotations(after, n).select("node_id", "resource", "node_name", "node_status")


@query(
    "enrichment_decisions",
    _BASE
    + ", acc AS (SELECT node_id, resource, external_id FROM after JOIN n ON id = node_id WHERE after.status = 'proposed' AND k % 3 = 0),"
    " j AS (SELECT node_id, max(CASE WHEN resource = 'uniprot' THEN external_id END) AS u, max(CASE WHEN resource = 'mygene' THEN external_id END) AS m FROM acc GROUP BY node_id)"
    " SELECT id, CASE WHEN u IS NULL THEN 'before' ELSE u END AS uniprot, m AS mygene, CASE WHEN u IS NULL OR u = 'old' THEN NULL ELSE CAST(k AS VARCHAR) END AS fact FROM n LEFT JOIN j ON node_id = id",
)
def _(s, d):
    """Of what waits, keys that 3 divides are accepted, others rejected; node properties after that."""
    n, (after, _, _) = _pass(s, d)
    pairs = after.select("node_id", "resource").join(n.select(F.col("id").alias("node_id"), "k"), "node_id")
    decisions = pairs.select("node_id", "resource", (F.col("k") % 3 == 0).alias("accept"), F.lit("me").alias("by"), F.lit(None).cast("string").alias("note"), F.lit(10.0).alias("ts"))
    held = enrichment.decide(after, n, decisions)[1]
    get = lambda r: F.element_at("properties", r)
    fact = F.get_json_object(get("uniprot"), "$.f")
    external = F.coalesce(F.get_json_object(get("uniprot"), "$.external_id"), get("uniprot"))
    return held.select("id", external.alias("uniprot"), F.get_json_object(get("mygene"), "$.external_id").alias("mygene"), F.when(fact != "old", fact).alias("fact"))


@query(
    "registry_hint_upsert",
    "WITH h AS (SELECT 'U' || user_id AS node_id, event_type AS registry, event_id, epoch(ts::TIMESTAMP) AS f, event_id % 3 <> 0 AS fresh FROM events),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY node_id, registry ORDER BY fresh DESC, f DESC, CAST(event_id AS VARCHAR)) AS r FROM h) SELECT node_id, registry, CAST(event_id AS VARCHAR) AS accession FROM r WHERE r = 1",
)
def _(s, d):
    """Events as answers of registries, every third one stored before."""
    e = tb.table(s, d, "events")
    h = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("node_id"), F.col("event_type").alias("registry"), F.col("event_id").cast("string").alias("accession"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("fetched_ts"), (F.col("event_id") % 3 != 0).alias("fresh"))
    old = h.where("NOT fresh").drop("fresh")
    return enrichment.upsert_hints(old, h.where("fresh").drop("fresh")).drop("fetched_ts")
