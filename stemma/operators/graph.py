"""Visibility, subgraphs, traversal and paths over node and edge frames.

Loops keep only a frontier and a visited set; each hop is written to the shared checkpoint folder,
so lineage stays short and a lost executor costs one hop's tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut


def visible(rows: DataFrame, include_proposed: bool = False) -> DataFrame:
    """Verified rows always, proposed ones on request, rejected ones never."""
    return rows.where(F.col("status").isin(["verified", "proposed"] if include_proposed else ["verified"]))


def current(edges: DataFrame) -> DataFrame:
    """Edges not invalidated; frames without the column are all current."""
    return edges.where(F.col("invalidated_ts").isNull()) if "invalidated_ts" in edges.columns else edges


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def verified_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return between(current(visible(edges)), visible(nodes))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' names and types; dangling edges drop out."""
    n = nodes.select("id", "name", "entity_type")
    ends = [n.select(*[F.col(c).alias(a if c == "id" else f"{a}_{c}") for c in n.columns]) for a in ("src", "dst")]
    return edges.join(ends[0], "src").join(ends[1], "dst")


def degree(edges: DataFrame) -> DataFrame:
    """Undirected incidence counts; parallel edges count."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame, direction: str = "both", relation_types: list[str] | None = None) -> DataFrame:
    """at, far, edge_id for each way an edge may be walked."""
    e = edges.where(F.col("relation_type").isin(relation_types)) if relation_types else edges
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("far"), F.col("id").alias("edge_id"))
    back = e.select(F.col("dst").alias("at"), F.col("src").alias("far"), F.col("id").alias("edge_id"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def traverse(nodes: DataFrame, edges: DataFrame, starts: list[str], max_hops: int = 2, direction: str = "both", relation_types: list[str] | None = None, include_proposed: bool = False, limit: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes with hop, touched edges). ``limit`` is the most nodes returned, in (hop, id) order.

    Edges that an expanded node touches are returned even where the far node fell to the limit.
    """
    seen = cut(visible(nodes, include_proposed))
    ways = cut(adjacency(current(visible(edges, include_proposed)), direction, relation_types))  # made once, read every hop
    first = seen.where(F.col("id").isin(starts)).select("id", F.lit(0).alias("hop"))
    reached, frontier, touched = cut(first), first, None
    for hop in range(1, max_hops + 1):
        step = cut(ways.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").join(seen.select(F.col("id").alias("far")), "far", "left_semi").select("far", "edge_id"))
        touched = step.select("edge_id") if touched is None else touched.unionByName(step.select("edge_id"))
        fresh = step.select(F.col("far").alias("id")).distinct().join(reached, "id", "left_anti").select("id", F.lit(hop).alias("hop"))
        if limit is not None:  # the feature: a bounded answer
            left = limit - reached.count()
            if left <= 0:
                break
            fresh = fresh.orderBy("id").limit(left)
        frontier = cut(fresh)
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    found = edges.join(touched.distinct().withColumnRenamed("edge_id", "id"), "id", "left_semi") if touched is not None else edges.limit(0)
    return seen.join(reached, "id"), found


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = 6, relation_types: list[str] | None = None, include_proposed: bool = False) -> DataFrame:
    """step, node_id, edge_id (null at the start); no rows where there is no path. Ties: smallest parent, then edge."""
    spark = nodes.sparkSession
    seen = visible(nodes, include_proposed)
    ends = {r["id"] for r in seen.where(F.col("id").isin(source, target)).select("id").collect()}
    schema = "step int, node_id string, edge_id string"
    if not {source, target} <= ends:
        return spark.createDataFrame([], schema)
    if source == target:
        return spark.createDataFrame([(0, source, None)], schema)
    ways = cut(adjacency(current(visible(edges, include_proposed)), "both", relation_types).join(seen.select(F.col("id").alias("far")), "far", "left_semi"))
    reached = spark.createDataFrame([(source, None, None, 0)], "id string, parent string, edge_id string, hop int")
    frontier = reached
    for hop in range(1, max_hops + 1):
        step = ways.join(frontier.select(F.col("id").alias("at")), "at").join(reached.select(F.col("id").alias("far")), "far", "left_anti")
        frontier = cut(step.groupBy(F.col("far").alias("id")).agg(F.min(F.struct("at", "edge_id")).alias("best")).select("id", F.col("best.at").alias("parent"), F.col("best.edge_id").alias("edge_id"), F.lit(hop).alias("hop")))
        reached = reached.unionByName(frontier)
        if not frontier.where(F.col("id") == target).isEmpty():
            break
        if frontier.isEmpty():
            return spark.createDataFrame([], schema)
    else:
        return spark.createDataFrame([], schema)
    path, at = [], target
    while at is not None:  # as many lookups as the path has hops
        row = reached.where(F.col("id") == at).first()
        path.append((row["hop"], at, row["edge_id"]))
        at = row["parent"]
    return spark.createDataFrame(path[::-1], schema)


def connected_components(node_ids: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component (smallest id reachable): minimum labels with pointer jumping."""
    both = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct())
    labels = cut(node_ids.select(F.col("id").alias("u"), F.col("id").alias("root")))
    for _ in range(rounds):
        around = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("far")), "v").groupBy("u").agg(F.min("far").alias("far"))
        near = labels.join(around, "u", "left").select("u", "root", F.least("root", F.coalesce("far", "root")).alias("near"))
        jump = labels.select(F.col("u").alias("near"), F.col("root").alias("jumped"))
        moved = cut(near.join(jump, "near").select("u", F.least("near", "jumped").alias("root"), (F.least("near", "jumped") != F.col("root")).alias("moved")))
        labels = moved.select("u", "root")
        if moved.where("moved").isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("root").alias("component"))
    raise RuntimeError("components did not settle")


def graph_page(nodes: DataFrame, edges: DataFrame, entity_type: str | None = None, relation_type: str | None = None, where: Column | None = None, include_proposed: bool = False, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of nodes by (name, id), and the current edges among them."""
    rows = visible(nodes, include_proposed)
    rows = rows.where(F.col("entity_type") == entity_type) if entity_type else rows
    rows = rows.where(where) if where is not None else rows
    page = rows.orderBy("name", "id").offset(offset).limit(limit)
    ways = current(visible(edges, include_proposed))
    ways = ways.where(F.col("relation_type") == relation_type) if relation_type else ways
    return page, between(ways, F.broadcast(page))  # a page: at most ``limit`` rows


def property_equals(properties: Column, key: str, value) -> Column:
    """Typed comparison of a JSON property: 1 and "1" differ."""
    kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(value)]
    quoted = "$['" + key.replace("'", "\\'") + "']"
    v = F.try_parse_json(properties)
    same_type = F.schema_of_variant(F.variant_get(v, quoted, "variant")) == {"boolean": "BOOLEAN", "bigint": "BIGINT", "double": "DOUBLE", "string": "STRING"}[kind]
    return F.coalesce(same_type & (F.try_variant_get(v, quoted, kind) == F.lit(value)), F.lit(False))


def filter_ids(ids: DataFrame, nodes: DataFrame, include_proposed: bool = False) -> DataFrame:
    """``ids`` (pos, id) whose node is visible; order and repeats stay."""
    return ids.join(visible(nodes, include_proposed).select("id"), "id", "left_semi").orderBy("pos")


def compact(nodes: DataFrame) -> DataFrame:
    """id, name, entity_type, status, snippet of at most 120 characters (aliases, then properties)."""
    aka = F.when(F.size("aliases") > 0, F.concat(F.lit("aka "), F.array_join(F.slice("aliases", 1, 3), ", ")))
    props = F.slice(F.map_entries("properties"), 1, 3)
    said = F.when(F.size(props) > 0, F.array_join(F.transform(props, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "))
    return nodes.select("id", "name", "entity_type", "status", F.substring(F.concat_ws(" · ", aka, said), 1, 120).alias("snippet"))


def project_nodes(rows: DataFrame) -> DataFrame:
    """Stored rows (aliases_json, properties_json, source_span as JSON text) with nested columns; unreadable JSON is null."""
    nested = {"aliases": ("aliases_json", "array<string>"), "properties": ("properties_json", "map<string,string>"), "span": ("source_span", "struct<start: int, end: int>")}
    return rows.select(*[c for c in rows.columns if c not in {k for k, _ in nested.values()}], *[F.from_json(c, kind).alias(name) for name, (c, kind) in nested.items() if c in rows.columns])


def candidate_neighbours(candidates: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """other_id, other_name, other_status, score of the node's pending merge candidates, best first."""
    mine = candidates.where((F.col("status") == "proposed") & ((F.col("a") == node_id) | (F.col("b") == node_id)))
    other = mine.select(F.when(F.col("a") == node_id, F.col("b")).otherwise(F.col("a")).alias("other_id"), "score")
    named = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("status").alias("other_status"))
    return other.join(named, "other_id").orderBy(F.desc("score"), "other_id")


def entity_context(nodes: DataFrame, edges: DataFrame, citations: DataFrame, documents: DataFrame, node_id: str, reviews: DataFrame | None = None, candidates: DataFrame | None = None, page: int = 50) -> DataFrame:
    """One row: the node, its relations with direction and far end, its mentions with excerpts, counts of both.

    A page of each is listed, in the order of its fields; counts are of all. ``reviews`` add the
    latest critic_score, ``candidates`` the pending merge candidates.
    """
    from ..functions.text import span_excerpt
    from .review import latest_review

    node = nodes.where(F.col("id") == node_id)
    ways = edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    ways = ways.select("id", "relation_type", "status", F.when(F.col("src") == node_id, "out").otherwise("in").alias("direction"), F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src")).alias("far"))
    ways = ways.join(nodes.select(F.col("id").alias("far"), F.col("name").alias("far_name")), "far")
    order = ["relation_type", "direction", "far", "far_name", "id", "status"]
    listed = lambda rows, fields, name: rows.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    cited = citations.where((F.col("kind") == "node") & (F.col("item_id") == node_id))
    first = cited.orderBy("doc_id", "start", "end").limit(page).join(documents.select("doc_id", "text"), "doc_id", "left")
    excerpt = span_excerpt(F.col("text"), F.col("start"), F.col("end")).alias("excerpt")
    parts = [listed(ways.orderBy(*order).limit(page), order, "relations"), ways.agg(F.count("*").alias("n_relations")), listed(first, ["doc_id", "start", "end", excerpt], "mentions"), cited.agg(F.count("*").alias("n_mentions"))]
    if reviews is not None:
        mine = latest_review(reviews.where((F.col("kind") == "node") & (F.col("item_id") == node_id)))
        parts.append(mine.agg(F.max("review_score").alias("critic_score")))
    if candidates is not None:
        near = candidate_neighbours(candidates, nodes, node_id).limit(page)
        parts.append(near.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "other_id", "other_name"))), lambda x: F.struct(x["other_id"].alias("id"), x["other_name"].alias("name"), (-x["k"]).alias("score"))).alias("candidates")))
    for part in parts:
        node = node.crossJoin(F.broadcast(part))  # one row each
    return node


def document_context(citations: DataFrame, nodes: DataFrame, edges: DataFrame, documents: DataFrame, doc_id, limit: int = 40_000) -> DataFrame:
    """Every item that cites the document, with labels; spans beyond the shown text are null."""
    doc = documents.where(F.col("doc_id") == doc_id).select("doc_id", F.substring("text", 1, limit).alias("shown"))
    labels = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), F.col("name").alias("label"))
    named = with_endpoints(edges, nodes).select(F.lit("edge").alias("kind"), F.col("id").alias("item_id"), F.concat("src_name", F.lit(" → "), "dst_name").alias("label"))
    cited = citations.where(F.col("doc_id") == doc_id).join(labels.unionByName(named), ["kind", "item_id"], "left")
    inside = F.col("end") <= F.length("shown")
    return cited.join(F.broadcast(doc), "doc_id").select("kind", "item_id", "label", F.when(inside, F.col("start")).alias("start"), F.when(inside, F.col("end")).alias("end"))


def provenance(items: DataFrame, citations: DataFrame, documents: DataFrame, reviews: DataFrame, page: int = 50) -> DataFrame:
    """Each item's first ``page`` citations by (doc_id, start, end) with their documents, their number in all, and its latest critic review.

    An item's citations are dealt to parts, whose first ones hold the item's first ones, so no task
    gets all citations of a much cited item.
    """
    from .review import latest_review

    place = F.struct("doc_id", "start", "end")
    dealt = citations.select("kind", "item_id", place.alias("at"), F.pmod(F.xxhash64("doc_id", "start", "end"), F.lit(64)).alias("part"))
    w = Window.partitionBy("kind", "item_id", "part").orderBy("at")
    few = dealt.withColumn("r", F.row_number().over(w)).where(F.col("r") <= page).groupBy("kind", "item_id").agg(F.slice(F.array_sort(F.collect_list("at")), 1, page).alias("at"))  # 64 pages at most
    named = few.select("kind", "item_id", F.explode("at").alias("at")).select("kind", "item_id", "at.*").join(documents.select("doc_id", "source"), "doc_id", "left")
    cited = named.groupBy("kind", "item_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "source", "start", "end"))).alias("citations"))
    numbers = citations.groupBy("kind", "item_id").agg(F.count("*").alias("n_citations"))
    out = items.join(cited, ["kind", "item_id"], "left").join(numbers, ["kind", "item_id"], "left").fillna({"n_citations": 0})
    return out.join(latest_review(reviews), ["kind", "item_id"], "left")


#: Columns of items and documents that a lineage shows; what a store lacks is null.
_LINEAGE = {"label": "string", "status": "string", "confidence": "double", "engine": "string", "model": "string", "prompt_version": "string", "created_ts": "double", "verified_by": "string", "verified_ts": "double", "note": "string", "source_doc": "long", "start": "int", "end": "int"}
_DOCUMENT = {"title": "string", "source_uri": "string", "source": "string", "fetched_ts": "double", "text": "string"}


def lineage(items: DataFrame, documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Where each item (kind, item_id, and what there is of ``_LINEAGE``) came from, one row an item.

    kind, item_id, label, status, confidence; extraction (engine, model, prompt_version, created_ts);
    review (verified_by, verified_ts, note) by people; document (doc_id, title, source_uri, source,
    fetched_ts), null where it isn't stored; span (start, end) and excerpt, null without a span;
    critic (engine, model, score, rationale, created_ts), the latest critic review, which is advice.
    """
    from ..functions.text import span_excerpt
    from .review import latest_review

    whole = lambda rows, fields: rows.withColumns({c: F.lit(None).cast(t) for c, t in fields.items() if c not in rows.columns})
    rows, docs = whole(items, _LINEAGE), whole(documents, _DOCUMENT)
    spanned = F.col("start").isNotNull() & F.col("end").isNotNull()
    docs = docs.select(F.col("doc_id").alias("source_doc"), F.struct("doc_id", *[c for c in _DOCUMENT if c != "text"]).alias("document"), F.col("text").alias("_text"))
    read = rows.join(docs, "source_doc", "left").select(
        "kind",
        "item_id",
        "label",
        "status",
        "confidence",
        F.struct("engine", "model", "prompt_version", "created_ts").alias("extraction"),
        F.struct("verified_by", "verified_ts", "note").alias("review"),
        "document",
        F.when(spanned, F.struct("start", "end")).alias("span"),
        F.when(spanned, span_excerpt(F.col("_text"), F.col("start"), F.col("end"))).alias("excerpt"),
    )
    said = whole(reviews, {"rationale": "string"})
    critic = latest_review(said).select("kind", "item_id", F.struct(*[F.col(f"review_{c}").alias(c) for c in ("engine", "model", "score", "rationale", "created_ts")]).alias("critic"))
    return read.join(critic, ["kind", "item_id"], "left")
