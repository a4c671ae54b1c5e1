"""Queries over what a serving layer shows: lineage, cited pages, communities of a given partition, registry answers, lookups, pack contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, graph, review, search
from ..sources import registry
from . import testbed as tb
from .catalogue import query
from .checkpoints import cut
from .pack_shelf import pack_contents
from .testbed import EDGES_SQL, NODES_SQL, REVIEWS_SQL, SUBGRAPH_SQL, normalize_sql, with_sql

# Lineage ----------------------------------------------------------------------------------

_EXCERPT = "CASE WHEN text IS NULL OR least(e, length(text)) <= s THEN '' ELSE substr(substr(text, greatest(s - 160, 0) + 1, s - greatest(s - 160, 0)) || '>>>' || substr(text, s + 1, least(e, length(text)) - s) || '<<<' || substr(text, least(e, length(text)) + 1, 160), 1, 600) END"
_CRITIC = "critic AS (SELECT item_id, arg_max({'engine': engine, 'model': model, 'score': score}, (created_ts, seq)) AS c FROM reviews GROUP BY item_id)"


@query(
    "lineage_nodes",
    with_sql(NODES_SQL, REVIEWS_SQL, _CRITIC)
    + ", i AS (SELECT *, CASE WHEN k % 3 <> 0 THEN CAST(k % 50 AS INTEGER) END AS s, CASE WHEN k % 3 <> 0 THEN CAST(k % 50 + 20 AS INTEGER) END AS e FROM kg_nodes)"
    " SELECT id AS item_id, name AS label, status, 'm' || (k % 2) AS model, CASE WHEN status <> 'proposed' THEN 'reviewer' || (k % 5) END AS verified_by, source AS doc_source, doc_id,"
    f" s AS start, CASE WHEN s IS NOT NULL THEN {_EXCERPT} END AS excerpt, c.engine AS critic_engine, c.score AS critic_score FROM i LEFT JOIN documents ON doc_id = source_doc LEFT JOIN critic ON item_id = id",
)
def _(s, d):
    n, k = tb.nodes(s, d), F.col("k")
    by = F.when(F.col("status") != "proposed", F.concat(F.lit("reviewer"), (k % 5).cast("string")))
    spanned = k % 3 != 0
    items = n.withColumns({"kind": F.lit("node"), "item_id": F.col("id"), "label": F.col("name"), "model": F.concat(F.lit("m"), (k % 2).cast("string")), "verified_by": by, "start": F.when(spanned, (k % 50).cast("int")), "end": F.when(spanned, (k % 50 + 20).cast("int"))})
    out = graph.lineage(items, tb.table(s, d, "documents").select("doc_id", "source", "text"), tb.reviews(s, d))
    return out.select("item_id", "label", "status", "extraction.model", "review.verified_by", F.col("document.source").alias("doc_source"), "document.doc_id", "span.start", "excerpt", F.col("critic.engine").alias("critic_engine"), F.col("critic.score").alias("critic_score"))


@query(
    "provenance_pages",
    "WITH c AS (SELECT 'P' || l_partkey AS item_id, l_orderkey % 97 AS doc_id, CAST(l_linenumber AS INTEGER) AS s, CAST(l_linenumber + l_quantity AS INTEGER) AS e FROM lineitem),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, s, e) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM c)"
    " SELECT item_id, n AS n_citations, string_agg(concat_ws(' ', doc_id, source, s, e), ';' ORDER BY doc_id, s, e) AS citations FROM r LEFT JOIN documents USING (doc_id) WHERE r <= 5 GROUP BY item_id, n",
)
def _(s, d):
    """Parts cited by the lines that order them, five citations a page."""
    lines = tb.table(s, d, "lineitem")
    end = (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("end")
    cited = lines.select(F.lit("node").alias("kind"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item_id"), (F.col("l_orderkey") % 97).alias("doc_id"), F.col("l_linenumber").cast("int").alias("start"), end)
    items = cited.select("kind", "item_id").distinct()
    out = graph.provenance(items, cited, tb.table(s, d, "documents"), tb.reviews(s, d), page=5)
    line = lambda x: F.concat_ws(" ", x["doc_id"].cast("string"), x["source"], x["start"].cast("string"), x["end"].cast("string"))
    return out.select("item_id", "n_citations", F.array_join(F.transform("citations", line), ";").alias("citations"))


@query(
    "review_queue_properties",
    with_sql(NODES_SQL, EDGES_SQL)
    + ", q AS (SELECT 'node' AS kind, id AS item_id, created_ts, k AS v FROM kg_nodes WHERE status = 'proposed' UNION ALL SELECT 'edge', id, created_ts, NULL FROM kg_edges WHERE status = 'proposed')"
    " SELECT kind, item_id, CAST(v AS VARCHAR) AS k, CASE WHEN kind = 'node' AND v % 2 = 0 THEN 'alias ' || item_id END AS first_alias FROM (SELECT * FROM q ORDER BY created_ts, kind, item_id LIMIT 200)",
)
def _(s, d):
    n, e = tb.nodes(s, d), tb.edges(s, d)
    alias = F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("alias "), "id"))).otherwise(F.array().cast("array<string>"))
    held = n.withColumns({"aliases": alias, "properties": F.create_map(F.lit("k"), F.col("k").cast("string"))})
    page = review.with_properties(review.review_queue(n, e, tb.reviews(s, d), limit=200), held, e)
    return page.select("kind", "item_id", F.element_at("properties", "k").alias("k"), F.get("aliases", F.lit(0)).alias("first_alias"))


# Communities of a given partition ---------------------------------------------------------

#: Customers and suppliers belong to their key's remainder by 7, parts to theirs.
_PARTITION = "m AS (SELECT id, 'community-00' || (k % 7) AS community_id, name FROM vn WHERE entity_type IN ('Customer', 'Supplier', 'Part'))"
_SUMMARY = (
    SUBGRAPH_SQL
    + f", {_PARTITION}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ve UNION ALL SELECT dst FROM ve) GROUP BY id),"
    " ranked AS (SELECT community_id, name, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(degree, 0) DESC, name, id) AS r FROM m LEFT JOIN deg USING (id)),"
    " top AS (SELECT community_id, count(*) AS member_count, string_agg(name, ', ' ORDER BY r) FILTER (r <= 5) AS top_members FROM ranked GROUP BY community_id),"
    " rel AS (SELECT a.community_id, relation_type, count(*) AS n FROM ve JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.community_id = b.community_id GROUP BY ALL),"
    " said AS (SELECT community_id, string_agg(relation_type || ' ×' || n, ', ' ORDER BY n DESC, relation_type) AS rels FROM rel GROUP BY community_id),"
    " summed AS (SELECT community_id, member_count, top_members, member_count || ' entities centered on ' || top_members || coalesce('; internal relations: ' || rels, '') AS summary FROM top LEFT JOIN said USING (community_id))"
)


def _partition(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, e = tb.nodes(s, d), tb.edges(s, d)
    n, e = graph.visible(n), cut(graph.verified_subgraph(n, e))
    members = n.where("entity_type IN ('Customer', 'Supplier', 'Part')").select("id", F.concat(F.lit("community-00"), (F.col("k") % 7).cast("string")).alias("community_id"))
    return n, e, members


@query("community_summaries_given", _SUMMARY + " SELECT * FROM summed")
def _(s, d):
    return community.summaries(*_partition(s, d))


@query("community_list", _SUMMARY + " SELECT community_id, member_count FROM summed ORDER BY member_count DESC, community_id LIMIT 3")
def _(s, d):
    return community.list_communities(community.summaries(*_partition(s, d)), 3).select("community_id", "member_count")


@query("community_members", SUBGRAPH_SQL + f", {_PARTITION} SELECT id, vn.name, entity_type, status FROM vn JOIN m USING (id) WHERE community_id = 'community-003'")
def _(s, d):
    n, e, members = _partition(s, d)
    return community.community_members(community.summaries(n, e, members), members, n, "community-003")


# Registries -------------------------------------------------------------------------------

_KIND = "(['Gene', 'Drug', 'Variant', 'Place'])[CAST(doc_id % 4 AS INTEGER) + 1]"


@query(
    "registry_hints",
    f"WITH r AS (SELECT doc_id, 'n' || doc_id AS name, {_KIND} AS entity_type, left(text, 40) AS t, doc_id % 17 = 0 AS failed, doc_id % 13 = 0 AS broken, doc_id % 11 = 0 AS none FROM documents WHERE text IS NOT NULL),"
    " h AS (SELECT *, CASE WHEN failed THEN 'http_500' WHEN broken THEN 'unreadable' WHEN none THEN 'not_found' END AS error FROM r WHERE entity_type <> 'Place')"
    " SELECT name, (MAP {'Gene': 'uniprot', 'Drug': 'pubchem', 'Variant': 'clinvar'})[entity_type] AS registry, CASE WHEN error IS NOT NULL THEN '' WHEN entity_type = 'Gene' THEN 'A' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS accession,"
    " CASE WHEN error IS NOT NULL OR t = '' THEN name ELSE t END AS label,"
    " CASE WHEN error IS NOT NULL THEN '' WHEN entity_type = 'Gene' THEN CASE WHEN doc_id % 3 = 0 THEN 'Species s' ELSE 'G' || doc_id || ' · Species s' END WHEN entity_type = 'Drug' THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE '분자식 C' || doc_id END ELSE 'G1 G2' END AS detail, error FROM h",
)
def _(s, d):
    """Each document is one answer: some calls failed, some answers are cut off, some hold no record."""
    rows = tb.table(s, d, "documents").where("text IS NOT NULL").withColumns({"id": F.col("doc_id").cast("string"), "t": F.substring("text", 1, 40), "none": F.col("doc_id") % 11 == 0, "odd": F.col("doc_id") % 3 == 0})
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Gene", "Drug", "Variant", "Place")]), (F.col("doc_id") % 4).cast("int") + 1)
    answers = {
        "Gene": "named_struct('results', IF(none, array(), array(named_struct('primaryAccession', concat('A', id), 'proteinDescription', named_struct('recommendedName', named_struct('fullName', named_struct('value', t))), 'genes', IF(odd, array(), array(named_struct('geneName', named_struct('value', concat('G', id))))), 'organism', named_struct('scientificName', 'Species s')))))",
        "Drug": "named_struct('PropertyTable', named_struct('Properties', IF(none, array(), array(named_struct('CID', doc_id, 'Title', t, 'MolecularFormula', IF(odd, NULL, concat('C', id)))))))",
        "Variant": "named_struct('result', named_struct('uids', IF(none, array(), array(id))))",
    }
    payload = F.coalesce(*[F.when(kind == name, F.to_json(F.expr(a))) for name, a in answers.items()], F.lit("{}"))
    record = F.concat(F.lit(',"'), "id", F.lit('":'), F.to_json(F.struct(F.col("t").alias("title"), F.array(F.lit("G1"), F.lit("G2"), F.lit("G3")).alias("gene_name"))))
    payload = F.when((kind == "Variant") & ~F.col("none"), F.concat(F.expr("concat('{\"result\":{\"uids\":[\"', id, '\"]')"), record, F.lit("}}"))).otherwise(payload)
    stored = rows.select(F.concat(F.lit("n"), "id").alias("name"), kind.alias("entity_type"), F.when(F.col("doc_id") % 13 == 0, F.substring(payload, 1, 9)).otherwise(payload).alias("payload"), F.when(F.col("doc_id") % 17 == 0, "http_500").alias("error"))
    return registry.registry_hints(cut(stored)).select("name", "registry", "accession", "label", "detail", "error")


_CAS = (
    "c AS (SELECT p_partkey AS cid, lower(p_name) || ' ' || p_partkey AS name, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS head, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS mid FROM part),"
    " n AS (SELECT cid, name, head || '-' || mid || '-' || CAST(list_sum(list_transform(range(1, 10), lambda i: i * CAST(reverse(head || mid)[i] AS INTEGER))) % 10 AS INTEGER) AS cas FROM c)"
)


def _compounds(s: SparkSession, d: str) -> DataFrame:
    """cid, name, cas: parts with a valid CAS number each."""
    cid = F.col("p_partkey").cast("string")
    head, mid = F.lpad(cid, 7, "0"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    digits = F.reverse(F.concat(head, mid))
    check = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + i * F.substring(digits, i, F.lit(1)).cast("int")) % 10
    return tb.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("cid"), F.concat(F.lower("p_name"), F.lit(" "), cid).alias("name"), F.concat_ws("-", head, mid, check.cast("string")).alias("cas"))


@query(
    "normalize_actives",
    f"WITH {_CAS} SELECT cid, CASE WHEN cid % 4 <> 0 AND cid % 9 <> 0 THEN cas WHEN cid % 9 = 0 THEN 'kept' END AS cas_number, CASE WHEN cid % 4 <> 0 AND cid % 9 <> 0 THEN CASE WHEN cid % 2 = 0 THEN 'Brand ' || cid ELSE upper(name) END END AS matched,"
    " CASE WHEN cid % 9 = 0 THEN NULL WHEN cid % 5 = 0 THEN 'WRONG' WHEN cid % 5 = 1 AND cid % 4 = 0 THEN cas END AS dropped, CASE WHEN cid % 4 = 0 AND cid % 9 <> 0 THEN 'no_cas_match' END AS normalization,"
    " CASE WHEN cid % 9 = 0 THEN 'made up' WHEN cid % 4 <> 0 AND cid % 3 = 0 THEN 'FRAC' END AS moa_scheme, CASE WHEN cid % 9 <> 0 AND cid % 4 <> 0 AND cid % 3 = 0 THEN 'M' || (cid % 6) END AS moa_code FROM n",
)
def _(s, d):
    """Parts as active ingredients: every fourth isn't registered, even ones go by an alias, every ninth is of another type."""
    c, cid = _compounds(s, d), F.col("cid")
    other = cid % 9 == 0
    own = F.when(other, "kept").when(cid % 5 == 0, "WRONG").when(cid % 5 == 1, F.col("cas"))
    brand = F.concat(F.lit("Brand "), cid.cast("string"))
    properties = F.map_filter(F.create_map(F.lit("cas_number"), own, F.lit("moa_scheme"), F.lit("made up")), lambda _, v: v.isNotNull())
    proposals = c.select(cid.alias("id"), F.when(other, "Crop").otherwise("ActiveIngredient").alias("entity_type"), F.when(cid % 2 == 0, "unheard of").otherwise(F.upper("name")).alias("name"), F.when(cid % 2 == 0, F.array(F.lit("nor this"), brand)).alias("aliases"), properties.alias("properties"))
    held = c.where(cid % 4 != 0)
    known = registry.build_registry(held.select(F.col("name").alias("surface"), F.col("cas").alias("code")).unionByName(held.select(F.lower(brand).alias("surface"), F.col("cas").alias("code"))))
    moa = registry.moa_registry(held.where(cid % 3 == 0).select(F.col("cas").alias("cas_number"), F.lit(" frac ").alias("scheme"), F.concat(F.lit("M"), (cid % 6).cast("string")).alias("code")))
    out = registry.normalize_domain(proposals, known, "cas", moa)
    get = lambda key, name: F.element_at("properties", key).alias(name)
    return out.select(F.col("id").alias("cid"), get("cas_number", "cas_number"), get("cas_matched_surface", "matched"), get("cas_number_dropped", "dropped"), get("normalization", "normalization"), get("moa_scheme", "moa_scheme"), get("moa_code", "moa_code"))


# Lookup and packs -------------------------------------------------------------------------


@query(
    "entity_lookup_properties",
    with_sql(NODES_SQL)
    + ", p AS (SELECT id, name, status, CASE WHEN entity_type = 'Part' AND k % 40 = 7 THEN 'sealed' ELSE 'plain' END AS state FROM kg_nodes),"
    " t AS (SELECT id, status, state, len(regexp_extract_all(lower(name || ' | state: ' || state), '[0-9a-z]+')) AS dl FROM p), a AS (SELECT count(*) AS n, avg(dl) AS avg_dl, count(*) FILTER (state = 'sealed') AS df FROM t),"
    " r AS (SELECT id, ln((n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg_dl)) AS r FROM t, a WHERE state = 'sealed' AND status = 'verified')"
    " SELECT id, CAST(3 AS INTEGER) AS tier, round(r / (1 + r), 6) AS score FROM r ORDER BY round(r, 9) DESC, id LIMIT 25",
)
def _(s, d):
    """Parts found by a property alone."""
    state = F.when((F.col("entity_type") == "Part") & (F.col("k") % 40 == 7), "sealed").otherwise("plain")
    n = tb.nodes(s, d).withColumns({"aliases": F.array().cast("array<string>"), "properties": F.create_map(F.lit("state"), state)})
    none = s.createDataFrame([], "node_id string, normalized_alias string")
    return search.entity_lookup(n, none, "sealed", limit=25, fuzzy=True).select("id", "tier", F.round("score", 6).alias("score"))


@query(
    "pack_contents",
    SUBGRAPH_SQL
    + f", al AS (SELECT id AS node_id, {normalize_sql('name')} AS a FROM vn WHERE entity_type = 'Part')"
    " SELECT 'aliases' AS what, (SELECT count(*) FROM al) AS n, (SELECT min(a) FROM al) AS first UNION ALL SELECT 'documents', (SELECT count(*) FROM documents WHERE doc_id IN (SELECT source_doc FROM vn)), NULL"
    " UNION ALL SELECT 'nodes', (SELECT count(*) FROM vn), (SELECT min(id) FROM vn) UNION ALL SELECT 'edges', (SELECT count(*) FROM ve), (SELECT min(id) FROM ve) UNION ALL SELECT 'community_members', (SELECT count(*) FROM vn), (SELECT min(id) FROM vn)",
)
def _(s, d):
    n, e = tb.nodes(s, d), tb.edges(s, d)
    aliases = n.where("entity_type = 'Part'").select(F.col("id").alias("node_id"), F.col("name").alias("surface"), F.col("normalized_name").alias("normalized_alias"))
    cited = n.select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), F.col("source_doc").alias("doc_id"))
    tables = pack_contents(n, e, cited, tb.table(s, d, "documents").select("doc_id"), aliases)
    first = {"aliases": "normalized_alias", "documents": None, "nodes": "id", "edges": "id", "community_members": "id"}
    out = None
    for what, column in first.items():
        one = tables[what].agg(F.count("*").alias("n"), (F.min(column) if column else F.lit(None).cast("string")).alias("first")).select(F.lit(what).alias("what"), "n", "first")
        out = one if out is None else out.unionByName(one)
    return out
