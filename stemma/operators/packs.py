"""Immutable verified-only packs: build, completeness, diff and staleness."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import current, verified_subgraph, visible


def pack_tables(nodes: DataFrame, edges: DataFrame, citations: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """What a pack ships: verified nodes, current verified edges between them, their citations and cited documents."""
    return with_cited(visible(nodes), verified_subgraph(nodes, edges), citations, documents)


def with_cited(n: DataFrame, e: DataFrame, citations: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Nodes and edges that ship, with their citations and cited documents."""
    shipped = n.select(F.lit("node").alias("kind"), F.col("id").alias("item_id")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("id").alias("item_id")))
    c = citations.join(shipped, ["kind", "item_id"], "left_semi")
    return {"nodes": n, "edges": e, "citations": c, "documents": documents.join(c.select("doc_id").distinct(), "doc_id", "left_semi")}


def content_hash(tables: dict[str, DataFrame]) -> str:
    """One hash of all rows, whatever their order or files: sums of row hashes, hashed."""
    parts = []
    for name in sorted(tables):
        t = tables[name]
        rows = t.select(F.sha2(F.to_json(F.struct(*sorted(t.columns))), 256).alias("h"))
        word = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
        got = rows.agg(F.count("*").alias("n"), *[F.sum(word(i)).alias(f"s{i}") for i in range(8)]).first()
        parts.append(f"{name}:{','.join(str(x) for x in got)}")
    import hashlib

    return "sha256:" + hashlib.sha256(";".join(parts).encode()).hexdigest()


class Incomplete(ValueError):
    """A pack whose extraction isn't known to be complete."""


def check_name(name: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or not name.strip("."):
        raise ValueError("pack names hold letters, digits, dots, dashes and underscores, and not dots alone")


def build_pack(spark: SparkSession, path: str, name: str, tables: dict[str, DataFrame], created_ts: float, states: DataFrame | None = None, allow_incomplete: bool = False, notes: dict | None = None) -> dict:
    """Write Parquet tables and a manifest; existing packs are never overwritten.

    ``states`` (``completeness`` of the shipped streams) gates the pack: where a stream is unknown
    or incomplete nothing is written, unless that is allowed, and the manifest says so either way.
    ``notes`` are further fields of the manifest.
    """
    check_name(name)
    gate = {"status": "not_checked"} if states is None else completeness_summary(states)
    if gate["status"] == "incomplete" and not allow_incomplete:
        raise Incomplete(f"{gate['unknown']} streams unknown, {gate['incomplete']} incomplete")
    for t, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}/{t}")
    stored = {t: spark.read.parquet(f"{path}/{name}/{t}") for t in tables}
    manifest = {"name": name, "created_ts": created_ts, "counts": {t: df.count() for t, df in stored.items()}, "content_hash": content_hash(stored), "completeness": gate} | (notes or {})
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("error").text(f"{path}/{name}/manifest")
    return manifest


def list_packs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, created_ts double, counts map<string,long>, content_hash string").json(f"{path}/*/manifest").orderBy(F.desc("created_ts"), "name")


def fingerprint(rows: DataFrame, material: list[str]) -> DataFrame:
    """id, fingerprint over the fields that carry meaning."""
    return rows.select("id", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(material)]), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def diff(old: DataFrame, new: DataFrame, fields: list[str], label: str | None = None) -> DataFrame:
    """id, change (added, removed, changed), fields that changed, comma-joined, and the new (else old) ``label``.

    List fields are compared whatever their order.
    """
    kinds = {f.name: f.dataType.typeName() for f in new.schema.fields}
    plain = lambda f: (unordered(F.col(f)) if kinds[f] == "array" else F.to_json(F.array_sort(F.map_entries(f))) if kinds[f] == "map" else F.col(f)).alias(f)
    keep = [F.col(label).alias("label")] if label else []
    a, b = (side.select("id", F.struct(*[plain(f) for f in fields], *keep).alias(k)) for side, k in ((old, "a"), (new, "b")))
    both = a.join(b, "id", "full_outer")
    moved = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(moved) > 0, "changed").alias("change")
    said = F.when(F.col("a").isNull() | F.col("b").isNull(), "").otherwise(F.array_join(moved, ",")).alias("fields")
    return both.select("id", change, said, *([F.coalesce("b.label", "a.label").alias("label")] if label else [])).where("change IS NOT NULL")


def unordered(items: Column) -> Column:
    """A list field made comparable."""
    return F.array_sort(items)


def with_triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``triple``: both ends' names (ids where unnamed) around the relation."""
    n = nodes.select("id", "name")
    ends = edges.join(n.select(F.col("id").alias("src"), F.col("name").alias("_a")), "src", "left").join(n.select(F.col("id").alias("dst"), F.col("name").alias("_b")), "dst", "left")
    said = F.concat(F.coalesce("_a", "src"), F.lit(" -["), "relation_type", F.lit("]-> "), F.coalesce("_b", "dst"))
    return ends.withColumn("triple", said).select(*edges.columns, "triple")


def manifest_changes(old: dict, new: dict, fields: list[str]) -> dict[str, tuple]:
    """Fields of two manifests that differ: (old, new)."""
    return {f: (old.get(f), new.get(f)) for f in fields if old.get(f) != new.get(f)}


def semantic_deltas(pack: DataFrame, live: DataFrame, material: list[str]) -> DataFrame:
    """One row: additions, invalidations, replacements (disjoint by id)."""
    a, b = fingerprint(pack, material).withColumnRenamed("fingerprint", "a"), fingerprint(live, material).withColumnRenamed("fingerprint", "b")
    both = a.join(b, "id", "full_outer")
    return both.agg(F.count_if(F.col("a").isNull()).alias("additions"), F.count_if(F.col("b").isNull()).alias("invalidations"), F.count_if(F.col("a") != F.col("b")).alias("replacements"))


def staleness(pack: DataFrame | None, live: DataFrame | None, material: list[str]) -> DataFrame:
    """One row: pack_items, live_items, pending (live ones beyond the pack's number), and the deltas.

    What needs a side that isn't there is null.
    """
    frames = {"pack_items": pack, "live_items": live}
    spark = next(f for f in (pack, live) if f is not None).sparkSession
    out = spark.range(1)
    for name, rows in frames.items():
        out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name)))) if rows is not None else out.withColumn(name, F.lit(None).cast("long"))  # one row
    if pack is None or live is None:
        deltas = [F.lit(None).cast("long").alias(c) for c in ("additions", "invalidations", "replacements")]
    else:
        out, deltas = out.crossJoin(F.broadcast(semantic_deltas(pack, live, material))), ["additions", "invalidations", "replacements"]  # one row
    known = F.col("live_items").isNotNull() & F.col("pack_items").isNotNull()
    return out.select("pack_items", "live_items", F.when(known, F.greatest(F.lit(0).cast("long"), F.col("live_items") - F.col("pack_items"))).alias("pending"), *deltas)


#: What tells one extraction stream from another; absent models and prompts are empty, absent decode parameters "null".
STREAM = {"engine": "", "model": "", "prompt_version": "", "decode_params": "null"}


def shipped_streams(nodes: DataFrame, edges: DataFrame, citations: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, content_hash, schema_version_id, engine, model, prompt_version, decode_params of all that a pack ships.

    Nodes, edges and citations carry the stream's columns (citations of old stores may lack them),
    nodes and edges source_doc and schema_version_id. A shipped item names its own stream; its
    citations name theirs where they carry one or come from another document. Where an item has
    several unnamed citations of its own document, every run of that document may be meant.
    """
    filled = [F.coalesce(c, F.lit(v)).alias(c) for c, v in STREAM.items()]
    n, e = visible(nodes), verified_subgraph(nodes, edges)
    items = n.select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), F.col("source_doc").alias("own_doc"), "schema_version_id")
    items = items.unionByName(e.select(F.lit("edge").alias("kind"), F.col("id").alias("item_id"), F.col("source_doc").alias("own_doc"), "schema_version_id"))
    shipped = n.select(F.col("source_doc").alias("doc_id"), "schema_version_id", *filled).unionByName(current(visible(edges)).select(F.col("source_doc").alias("doc_id"), "schema_version_id", *filled)).distinct()
    cited = citations.join(items, ["kind", "item_id"])
    named = cited.where(F.col("engine").isNotNull() | (F.col("own_doc") != F.col("doc_id"))).select("doc_id", "schema_version_id", *filled).distinct()
    unnamed = cited.where(F.col("engine").isNull() & (F.col("own_doc") == F.col("doc_id")))
    doubtful = unnamed.groupBy("kind", "item_id", "doc_id", "schema_version_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "schema_version_id").distinct()
    meant = runs.join(doubtful, ["doc_id", "schema_version_id"], "left_semi").select("doc_id", "schema_version_id", *filled)
    every = shipped.unionByName(named).unionByName(meant).distinct()
    return every.join(documents.select("doc_id", "content_hash"), "doc_id").select("doc_id", "content_hash", "schema_version_id", *STREAM)


def completeness(streams: DataFrame, runs: DataFrame, chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each shipped stream's state: satisfied if a complete run has no chunk that didn't succeed, else incomplete, else unknown.

    ``runs`` and ``chunks_of`` count every run of the stream and the chunks of these.
    """
    keys = keys or ["doc_id", "engine"]
    done = chunks.groupBy("run_id").agg(F.count_if(F.col("status") != "succeeded").alias("open"), F.count("*").alias("chunks"))
    known = runs.join(done, "run_id", "left").withColumn("ok", (F.col("status") == "complete") & (F.coalesce("open", F.lit(0)) == 0))
    by = known.groupBy(*keys).agg(F.max("ok").alias("ok"), F.count("*").alias("runs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks_of"))
    state = F.when(F.col("ok"), "satisfied").when(F.col("runs") > 0, "incomplete").otherwise("unknown")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return streams.select(*keys).distinct().join(by, keys, "left").select(*keys, state.alias("state"), zero("runs"), zero("chunks_of"))


def completeness_summary(states: DataFrame) -> dict:
    """status (not_applicable, complete, incomplete) and the counts of streams by state."""
    n = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}  # three rows at most
    open_ = n.get("unknown", 0) + n.get("incomplete", 0)
    return {"status": "not_applicable" if not n else "incomplete" if open_ else "complete", "streams": sum(n.values()), "unknown": n.get("unknown", 0), "incomplete": n.get("incomplete", 0)}
