"""Writes that touch a whole graph store: inserting proposals and merging nodes, frames in and frames out.

A store's frames and the columns they need (others are kept):

* nodes: id, entity_type, name, normalized_name, aliases, properties (map), status;
  embedding, embedding_model and review_note where there are any
* edges: id, relation_type, src, dst, status, invalidated_ts
* aliases: node_id, normalized_alias, surface
* citations: kind, item_id, doc_id and whatever describes the place
* candidates: a, b (a < b), status
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..plans.checkpoints import cut
from .graph import connected_components, visible
from .resolve import fill_properties, in_order


@dataclass
class Store:
    nodes: DataFrame
    edges: DataFrame
    aliases: DataFrame
    citations: DataFrame
    candidates: DataFrame | None = None


def live(edges: DataFrame) -> Column:
    return F.col("status").isin("proposed", "verified") & F.col("invalidated_ts").isNull()


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


# Merging ----------------------------------------------------------------------------------


def repoint_edges(edges: DataFrame, target: str, source: str) -> DataFrame:
    """``edges`` with ``outcome`` and ``keeper``: source's current edges are moved to the target.

    A moved edge that would loop, or that repeats a live one (an unmoved one before a moved one,
    then by id), is rejected where it stands and names its keeper; edges that aren't current stay.
    """
    touches = F.coalesce(live(edges) & ((F.col("src") == source) | (F.col("dst") == source)), F.lit(False))
    held = F.coalesce(live(edges) & ((F.col("src") == target) | (F.col("dst") == target)), F.lit(False))
    to = {c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c)) for c in ("src", "dst")}
    near = edges.where(touches | held)  # only edges at the two nodes are compared
    marked = cut(near.withColumns({"_moved": touches, "_src": F.when(touches, to["src"]).otherwise(F.col("src")), "_dst": F.when(touches, to["dst"]).otherwise(F.col("dst"))}))
    loop = F.col("_moved") & (F.col("_src") == F.col("_dst"))
    keys = ["relation_type", "_src", "_dst", *(["schema_version_id"] if "schema_version_id" in edges.columns else [])]
    keeper = marked.where(~loop).groupBy(*keys).agg(F.min(F.struct("_moved", "id"))["id"].alias("keeper"))  # one row a triple at the target
    found = marked.join(keeper, keys, "left")
    again = F.col("_moved") & ~loop & (F.col("keeper") != F.col("id"))
    outcome = F.when(loop, "self_loop").when(again, "duplicate").when(F.col("_moved"), "repointed")
    out = found.withColumn("outcome", outcome).withColumn("keeper", F.when(F.col("outcome") == "duplicate", F.col("keeper")))
    gone = F.col("outcome").isin("self_loop", "duplicate")
    moved = F.col("outcome") == "repointed"
    decided = out.withColumns({"status": F.when(gone, "rejected").otherwise(F.col("status")), "src": F.when(moved, F.col("_src")).otherwise(F.col("src")), "dst": F.when(moved, F.col("_dst")).otherwise(F.col("dst"))})
    rest = edges.where(~(touches | held)).withColumns({"outcome": F.lit(None).cast("string"), "keeper": F.lit(None).cast(dict(edges.dtypes)["id"])})
    return rest.unionByName(cut(decided.select(*edges.columns, "outcome", "keeper")))


def check_merge(nodes: DataFrame, target: str, source: str) -> None:
    """Both nodes visible and of one type; a verified one is never merged into a proposed one."""
    if target == source:
        raise ValueError("a node can't be merged into itself")
    rows = {r["id"]: r for r in visible(nodes, True).where(F.col("id").isin(target, source)).select("id", "entity_type", "status").collect()}
    if len(rows) != 2 or rows[target]["entity_type"] != rows[source]["entity_type"]:
        raise ValueError("both nodes must be visible and of one type")
    if rows[source]["status"] == "verified" != rows[target]["status"]:
        raise ValueError("a verified node can't be merged into a proposed one")


def merge_store(store: Store, target: str, source: str, by: str = "user", note: str | None = None, ts: float = 0.0) -> tuple[Store, DataFrame]:
    """(the store after folding ``source`` into ``target``, one row of counts).

    The target gains the source's surfaces and the properties it lacks, and loses its embedding if
    that changed it; citations follow; edges move as in ``repoint_edges``, and a duplicate's
    citations go to its keeper; the source stays as a rejected row that names the target and keeps
    no aliases; the pair's candidate is merged and the source's other pending ones are stale.
    """
    check_merge(store.nodes, target, source)
    a, b = F.lit(target), F.lit(source)
    own = store.nodes.where(F.col("id") == b)
    listed = own.select(F.posexplode(F.concat(F.array("name"), _strings("aliases"))).alias("pos", "surface"))
    stored = store.aliases.where(F.col("node_id") == b).select(F.lit(1 << 30).alias("pos"), "surface")
    surfaces = listed.unionByName(stored).withColumn("key", normalize_name(F.col("surface"))).where("key <> ''")
    surfaces = cut(surfaces.groupBy("key").agg(F.min(F.struct("pos", "surface")).alias("first")).select("key", "first.pos", "first.surface"))
    theirs = store.nodes.where(F.col("id") == a)
    known = theirs.select(F.explode(F.concat(F.array("normalized_name"), F.transform(_strings("aliases"), normalize_name))).alias("key"))
    fresh = surfaces.join(known, "key", "left_anti").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surface"))), lambda x: x["surface"]).alias("_more"))
    given = fresh.crossJoin(F.broadcast(own.select(F.col("properties").alias("_given"))))  # one row each

    hit = F.col("id") == a
    joined = store.nodes.crossJoin(F.broadcast(given))  # one row
    lacking = F.map_filter("_given", lambda k, _: ~F.map_contains_key(F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>")), k))
    changed = hit & ((F.size("_more") > 0) | (F.size(lacking) > 0))
    columns = {
        "aliases": F.when(hit, F.concat(_strings("aliases"), "_more")).otherwise(F.col("aliases")),
        "properties": F.when(hit, fill_properties("properties", "_given")).otherwise(F.col("properties")),
        "status": F.when(F.col("id") == b, "rejected").otherwise(F.col("status")),
        "review_note": F.when(F.col("id") == b, F.lit(note or f"merged-into:{target}")).otherwise(F.col("review_note") if "review_note" in store.nodes.columns else F.lit(None).cast("string")),
    }
    for c in ("embedding", "embedding_model"):
        if c in store.nodes.columns:
            columns[c] = F.when(changed, None).otherwise(F.col(c))
    nodes = joined.withColumns(columns).drop("_more", "_given")

    kept = store.aliases.where(F.col("node_id") != b)
    have = kept.where(F.col("node_id") == a).select(F.col("normalized_alias").alias("key"))
    added = surfaces.join(have, "key", "left_anti").select(a.alias("node_id"), F.col("key").alias("normalized_alias"), "surface")
    moved = repoint_edges(store.edges, target, source)  # edges are read as they are stored; what changed is written once
    again = moved.where("keeper IS NOT NULL").select(F.lit("edge").alias("kind"), F.col("id").alias("item_id"), "keeper")
    citations = store.citations.join(again, ["kind", "item_id"], "left")
    to = F.when((F.col("kind") == "node") & (F.col("item_id") == b), a).otherwise(F.coalesce("keeper", "item_id"))
    citations = citations.withColumn("item_id", to).select(*store.citations.columns)
    candidates = store.candidates
    if candidates is not None:
        pair = (F.col("a") == F.least(a, b)) & (F.col("b") == F.greatest(a, b))
        others = (F.col("a") == b) | (F.col("b") == b)
        open_ = F.col("status") == "proposed"
        decided = {"status": F.when(open_ & pair, "merged").when(open_ & others, "stale").otherwise(F.col("status"))}
        if "decided_by" in candidates.columns:
            decided |= {"decided_by": F.when(open_ & pair, F.lit(by)).when(open_ & others, F.lit(f"system:merge-by:{by}")).otherwise(F.col("decided_by")), "decided_ts": F.when(open_ & (pair | others), F.lit(ts)).otherwise(F.col("decided_ts"))}
        candidates = candidates.withColumns(decided)
    report = moved.agg(*[F.count_if(F.col("outcome") == k).alias(n) for k, n in (("repointed", "edges_repointed"), ("duplicate", "edges_deduplicated"), ("self_loop", "edges_self_loop_rejected"))])
    return Store(nodes, moved.select(*store.edges.columns), kept.unionByName(added), citations, candidates), report


# Proposals --------------------------------------------------------------------------------


def bind_entities(store: Store, entities: DataFrame) -> DataFrame:
    """``entities`` with normalized_name, node_id and minted (whether the entity's node is new, by its first mention).

    In seq order an entity binds to a visible node of its type by exact key, else to one that knows
    its key as an alias, aliases of earlier mentions included, else it mints a node. Mentions with
    one key and the same aliases bind alike, so only their first goes on; forms and known nodes that
    share keys make linked sets, and each of these is walked alone in order.
    """
    named = entities.withColumn("normalized_name", normalize_name(F.col("name")))
    named = cut(named.withColumn("alias_keys", F.array_sort(F.array_distinct(F.filter(F.transform(_strings("aliases"), normalize_name), lambda k: k != "")))))
    forms = cut(named.groupBy("entity_type", "normalized_name", "alias_keys").agg(F.min(F.struct("seq", "id")).alias("first")).select("entity_type", "normalized_name", "alias_keys", "first.seq", "first.id"))
    wanted = forms.select("entity_type", F.explode(F.concat(F.array("normalized_name"), "alias_keys")).alias("key")).distinct()
    seen = visible(store.nodes, True).select("id", "entity_type", "normalized_name")
    exact = seen.select("entity_type", F.col("normalized_name").alias("key"), "id").join(wanted, ["entity_type", "key"], "left_semi").groupBy("entity_type", "key").agg(F.min("id").alias("exact"))
    alias = seen.join(store.aliases.select(F.col("node_id").alias("id"), F.col("normalized_alias").alias("key")), "id").join(wanted, ["entity_type", "key"], "left_semi").groupBy("entity_type", "key").agg(F.min("id").alias("alias"))
    owners = exact.join(alias, ["entity_type", "key"], "full_outer")

    node = lambda c: F.concat_ws("\x1f", "entity_type", c)
    links = forms.select(node("normalized_name").alias("src"), F.explode(F.concat(F.array(node("normalized_name")), F.transform("alias_keys", lambda k: F.concat_ws("\x1f", "entity_type", k)))).alias("dst"))
    keys = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = cut(connected_components(keys, links.where("src <> dst").distinct()))
    place = parts.withColumnRenamed("id", "at")
    none = F.lit(None)
    rows = forms.withColumn("at", node("normalized_name")).join(place, "at").select("component", "entity_type", F.col("normalized_name").alias("key"), "alias_keys", "seq", "id", none.cast("string").alias("exact"), none.cast("string").alias("alias"))
    rows = rows.unionByName(owners.withColumn("at", node("key")).join(place, "at").select("component", "entity_type", "key", F.array().cast("array<string>").alias("alias_keys"), none.cast("long").alias("seq"), none.cast("string").alias("id"), "exact", "alias"))

    kind = "entity_type string, normalized_name string, alias_keys array<string>, node_id string, new boolean"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, exact, alias = None, {}, {}
        for batch in batches:
            out = []
            for component, entity_type, key, keys, seq, id_, known, known_alias in zip(*(c.to_pylist() for c in batch.columns)):
                if component != at:
                    at, exact, alias = component, {}, {}
                if seq is None:  # what the store knows, before all forms
                    exact |= {key: known} if known is not None else {}
                    alias |= {key: known_alias} if known_alias is not None else {}
                    continue
                owner = exact.get(key) or alias.get(key)
                minted = owner is None
                if minted:
                    owner = exact[key] = id_
                for k in (*([] if minted else [key]), *keys):
                    alias.setdefault(k, owner)
                out.append((entity_type, key, keys, owner, minted))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["entity_type", "normalized_name", "alias_keys", "node_id", "new"])

    bound = in_order(rows, "component", "seq").mapInArrow(walk, kind)  # a null seq comes first
    joined = named.join(bound, ["entity_type", "normalized_name", "alias_keys"])
    return joined.withColumn("minted", F.col("id") == F.col("node_id")).drop("alias_keys", "new")


def insert_proposed(store: Store, entities: DataFrame, relations: DataFrame) -> tuple[Store, DataFrame, DataFrame]:
    """(the store with the proposals, id_map (id, node_id), one row of counts).

    entities: seq, id, entity_type, name, aliases, properties, confidence, doc_id, start, end,
    synthesized. relations: seq, id, relation_type, src, dst (entity ids), confidence, doc_id, start,
    end. New nodes and edges are proposed; a mention of a known node adds the surfaces and
    properties that it lacks; a triple that a current edge holds adds a citation only. Every
    mention is a citation. Relations with unknown ends are an error.
    """
    from ..plans.shipping import ship

    ship(store.nodes.sparkSession)
    bound = cut(bind_entities(store, entities))
    id_map = bound.select("id", "node_id")
    base = bound.where("minted").select("id", "entity_type", "name", "normalized_name", _strings("aliases").alias("aliases"), "properties", F.lit("proposed").alias("status"), "confidence", F.col("doc_id").alias("source_doc"))
    before = store.nodes.unionByName(base, allowMissingColumns=True)

    again = bound.where("NOT minted")
    said = again.select("node_id", "seq", F.posexplode(F.concat(F.array("name"), _strings("aliases"))).alias("pos", "surface")).withColumn("key", normalize_name(F.col("surface"))).where("key <> ''")
    said = cut(said.groupBy("node_id", "key").agg(F.min(F.struct("seq", "pos", "surface")).alias("first")))
    known = before.join(said.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("node_id"), F.explode(F.concat(F.array("normalized_name"), F.transform(_strings("aliases"), normalize_name))).alias("key"))
    more = said.join(known, ["node_id", "key"], "left_anti").groupBy(F.col("node_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["surface"]).alias("_more"))
    facts = again.select("node_id", "seq", F.explode("properties").alias("key", "value")).groupBy("node_id", "key").agg(F.min_by("value", "seq").alias("value"))
    facts = facts.groupBy(F.col("node_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_given"))
    none = F.create_map().cast("map<string,string>")
    joined = before.join(more, "id", "left").join(facts, "id", "left").withColumn("properties", F.coalesce("properties", none)).withColumn("_given", F.coalesce("_given", none))
    nodes = joined.withColumns({"aliases": F.concat(_strings("aliases"), _strings("_more")), "properties": fill_properties("properties", "_given")}).drop("_more", "_given")

    new = bound.where("minted").select("node_id", "seq", F.posexplode(_strings("aliases")).alias("pos", "surface")).withColumn("key", normalize_name(F.col("surface"))).where("key <> ''")
    new = new.groupBy("node_id", "key").agg(F.min(F.struct("seq", "pos", "surface")).alias("first"))
    both = said.unionByName(new).groupBy("node_id", F.col("key").alias("normalized_alias")).agg(F.min("first")["surface"].alias("surface"))
    aliases = store.aliases.unionByName(both.join(store.aliases.select("node_id", "normalized_alias"), ["node_id", "normalized_alias"], "left_anti"))

    ends = id_map.select(F.col("id").alias("_end"), "node_id")
    placed = relations
    for c in ("src", "dst"):
        got = F.when(F.col("node_id").isNull(), F.raise_error(F.concat(F.lit("relation with an unknown end: "), F.col("id"))).cast("string")).otherwise(F.col("node_id"))
        placed = placed.join(ends.withColumnRenamed("_end", c), c, "left").withColumn(c, got).drop("node_id")
    triple = ["relation_type", "src", "dst"]
    held = store.edges.where(live(store.edges)).groupBy(*triple).agg(F.min("id").alias("held"))
    first = placed.groupBy(*triple).agg(F.min(F.struct("seq", "id"))["id"].alias("first"))
    placed = cut(placed.join(first, triple).join(held, triple, "left").withColumn("edge_id", F.coalesce("held", "first")))
    made = placed.where("held IS NULL AND id = first").select("id", *triple, F.lit("proposed").alias("status"), "confidence", F.lit(None).cast("double").alias("invalidated_ts"))
    edges = store.edges.unionByName(made, allowMissingColumns=True)

    place = ["doc_id", "start", "end"]
    cited = bound.select(F.lit("node").alias("kind"), F.col("node_id").alias("item_id"), *place).unionByName(placed.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("item_id"), *place))
    counts = bound.agg(F.count_if("minted").alias("nodes_new"), F.count_if(~F.col("minted")).alias("nodes_merged"), F.count_if("synthesized").alias("synthesized_endpoints"))
    stats = counts.crossJoin(F.broadcast(placed.agg(F.count_if(F.col("held").isNull() & (F.col("id") == F.col("first"))).alias("edges_new"), F.count_if(F.col("held").isNotNull() | (F.col("id") != F.col("first"))).alias("edges_merged"))))  # one row
    return replace(store, nodes=nodes, edges=edges, aliases=aliases, citations=store.citations.unionByName(cited, allowMissingColumns=True)), id_map, stats
