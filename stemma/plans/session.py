"""Snapshots on disk and a read session over packs: what a serving layer asks for, as frames."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, leiden, graph, search
from ..operators.text_index import TextIndex

TABLES = {
    "nodes": "id string, entity_type string, name string, normalized_name string, aliases array<string>, properties map<string,string>, status string, confidence double, embedding array<float>, embedding_model string, created_ts double",
    "edges": "id string, relation_type string, src string, dst string, status string, confidence double, invalidated_ts double, created_ts double",
    "citations": "kind string, item_id string, doc_id long, start int, end int",
    "documents": "doc_id long, text string, source string, fetched_ts double",
}


@dataclass(frozen=True)
class Graph:
    """Frames of one snapshot; changes make a new one."""

    nodes: DataFrame
    edges: DataFrame
    citations: DataFrame
    documents: DataFrame

    def save(self, path: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("error").parquet(f"{path}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Graph:
        """Columns a snapshot lacks are null, so older ones stay readable."""
        return cls(**{name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in TABLES.items()})

    def list_documents(self) -> DataFrame:
        return self.documents.orderBy("fetched_ts", "doc_id")


def bundle(pack: str, target: str) -> None:
    """A pack's files as one zip on the driver."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(Path(pack).rglob("*")):
            if f.is_file() and not f.name.startswith((".", "_")):
                z.write(f, f"{Path(pack).name}/{f.relative_to(pack)}")


@dataclass(frozen=True)
class Answer:
    """A search's result with what it took to get there, and the pack that it came from."""

    query: str
    search_tier: str
    expansion_terms: list[str]
    expansion_error: str | None
    results: DataFrame
    detail: bool
    pack: dict | None


class PackSession:
    """Reads over one loaded graph; every answer is a frame.

    ``pack`` names the pack (pack_id, content_hash), ``shipped`` has its aliases, communities and
    their members, ``index`` is the text index over its nodes. What isn't given is worked out.
    """

    def __init__(
        self,
        loaded: Graph,
        embed: Callable[[str], list[float]] | None = None,
        model: str | None = None,
        rerank: Callable[[DataFrame, str], DataFrame] | None = None,
        pack: dict | None = None,
        shipped: dict[str, DataFrame] | None = None,
        index: TextIndex | None = None,
    ):
        self.graph, self.embed, self.model, self.rerank = loaded, embed, model, rerank
        self.pack, self.shipped, self.index = pack, shipped or {}, index

    def schema(self) -> tuple[DataFrame, DataFrame]:
        return self.graph.nodes.groupBy("entity_type").count(), self.graph.edges.groupBy("relation_type").count()

    def get_entity(self, node_id: str) -> DataFrame:
        g = self.graph
        return graph.entity_context(graph.visible(g.nodes), graph.current(graph.visible(g.edges)), g.citations, g.documents, node_id)

    def _scores(self, query: str) -> DataFrame:
        """(key, score) over all rows of the graph."""
        if self.index is not None:
            return self.index.scores(query)
        return search.bm25(self.graph.nodes.withColumn("body", search.node_text(self.graph.nodes)), "id", "body", query)

    def entity_lookup(self, name: str | None = None, id: str | None = None, detail: bool = False, **options) -> DataFrame:
        """The node of an id (score 1.0), else those of a name; ``detail`` adds the nodes' columns and the documents they come from."""
        nodes = self.graph.nodes
        if id is not None:
            include = options.get("include_proposed", False)
            hits = graph.visible(nodes, include).where(F.col("id") == id).select("id", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
        elif name is None:
            raise ValueError("a lookup needs an id or a name")
        else:
            aliases = self.shipped.get("aliases")
            if aliases is None:
                from ..functions.text import normalize_name

                spread = nodes.select(F.col("id").alias("node_id"), F.explode("aliases").alias("surface"))
                aliases = spread.withColumn("normalized_alias", normalize_name(F.col("surface")))
            hits = search.entity_lookup(nodes, aliases, name, **{"fuzzy": True, "lexical": self._scores} | options)
        if not detail:
            return hits.join(graph.compact(nodes), "id").orderBy("tier", F.desc("score"), "id")
        rows = nodes.join(F.broadcast(hits), "id")  # at most ``limit`` rows
        rows = rows if "source_doc" in rows.columns else rows.withColumn("source_doc", F.lit(None).cast(dict(self.graph.citations.dtypes)["doc_id"]))
        return search.citing_documents(rows, self.graph.citations).orderBy("tier", F.desc("score"), "id")

    def traverse(self, starts: list[str], **options) -> tuple[DataFrame, DataFrame]:
        return graph.traverse(self.graph.nodes, self.graph.edges, starts, **options)

    def find_path(self, source: str, target: str, **options) -> DataFrame:
        return graph.shortest_path(self.graph.nodes, self.graph.edges, source, target, **options)

    def graph_query(self, **options) -> tuple[DataFrame, DataFrame]:
        return graph.graph_page(self.graph.nodes, self.graph.edges, **options)

    def communities(self, limit: int | None = None) -> DataFrame:
        """The shipped communities, else those found now; the ``limit`` largest."""
        found = self.shipped.get("communities")
        if found is None:
            n, e = graph.visible(self.graph.nodes), graph.verified_subgraph(self.graph.nodes, self.graph.edges)
            found = community.summaries(n, e, community.communities(community.label_propagation(n, e)).select("id", "community_id"))
        return found if limit is None else community.list_communities(found, limit)

    def community_members(self, community_id: str) -> DataFrame:
        """Members of a shipped community; a pack without communities knows none."""
        if not {"communities", "community_members"} <= self.shipped.keys():
            raise community.UnknownCommunity(community_id)
        return community.community_members(self.shipped["communities"], self.shipped["community_members"], self.graph.nodes, community_id)

    def provenance(self, kind: str, item_id: str, reviews: DataFrame) -> DataFrame:
        """The lineage of one node or edge; without a row where there is no such item."""
        if kind not in ("node", "edge"):
            raise ValueError(f"unknown kind {kind!r}")
        rows, label = (self.graph.nodes, "name") if kind == "node" else (self.graph.edges, "relation_type")
        item = rows.where(F.col("id") == item_id).withColumns({"kind": F.lit(kind), "item_id": F.col("id"), "label": F.col(label)})
        return graph.lineage(item, self.graph.documents, reviews.where((F.col("kind") == kind) & (F.col("item_id") == item_id)))

    def semantic_search(self, query: str, k: int = 10, expand: bool = False, min_score: float = 0.0) -> tuple[DataFrame, str]:
        """(key, score, rank) and the tier used: vectors join in only where the graph has the embedder's model."""
        n = graph.visible(self.graph.nodes).withColumn("body", search.node_text(self.graph.nodes))

        def lexical(q: str, most: int | None = None) -> DataFrame:
            """Statistics over all rows of the graph; only visible ones are answers."""
            scored = self._scores(q).join(n.select(F.col("id").alias("key")), "key", "left_semi")
            return scored if most is None else search.top_k(scored, most)

        extra = search.expand_query(query) if expand else []
        vectors = n.where(F.col("embedding_model") == self.model) if self.embed and self.model and "embedding" in n.columns else None
        tier = "fts5"
        if vectors is not None and not vectors.isEmpty():
            tier += "+vec-rrf"
            found = search.hybrid_search(n, "id", "body", query, vectors, "id", "embedding", self.embed(query), 3 * k if self.rerank else k, min_score, extra, lexical)
        elif extra:
            found = search.top_k(search.rrf([lexical(q, 2 * k) for q in [query, *extra]]).where(F.col("score") >= min_score), k)
        else:
            found = search.top_k(lexical(query).where(F.col("score") >= min_score), k)
        if self.rerank:
            raw = self.rerank(found.join(n.select(F.col("id").alias("key"), "body"), "key"), query)
            found = search.top_k(raw.select("key", search.sigmoid(F.col("raw")).alias("score")), k)
        return found, tier + ("+llm-expansion" if extra else "")

    def answer(self, query: str, k: int = 10, expand: bool = False, min_score: float = 0.0, detail: bool = False) -> Answer:
        """``semantic_search`` with compact nodes (``detail``: whole ones) beside score and rank, and what the answer rests on."""
        found, tier = self.semantic_search(query, k, expand, min_score)
        shown = self.graph.nodes if detail else graph.compact(self.graph.nodes)
        rows = shown.join(F.broadcast(found.withColumnRenamed("key", "id")), "id").orderBy("rank")  # k rows
        return Answer(query, tier, search.expand_query(query) if expand else [], None, rows, detail, self.pack)


def detect_communities(nodes: DataFrame, edges: DataFrame, method: str = "auto", resolution: float | None = None) -> DataFrame:
    """id, label, community_id by label propagation (``auto``), ``leiden`` (modularity) or ``cpm`` at a resolution."""
    if method == "cpm" and not (resolution and resolution > 0):
        raise ValueError("cpm needs a resolution above zero")
    if method in ("leiden", "cpm"):
        return community.communities(leiden.leiden(nodes, edges, resolution if method == "cpm" else None))
    if method not in ("auto", "label_propagation"):
        raise ValueError(f"unknown method {method!r}")
    return community.communities(community.label_propagation(nodes, edges))


def formulate_query(answer: str, terms: int = 6, width: int = 120) -> str | None:
    """The query of a model's fenced JSON answer; None where there is no usable one."""
    from ..operators.extraction import _FENCE

    try:
        query = json.loads(_FENCE.search(answer)[1])["query"]  # type: ignore[index]
        words = query.split()
    except (TypeError, KeyError, ValueError, AttributeError):
        return None
    line = " ".join(words)
    return " ".join(words[:terms]) if line and len(line) <= width else None


# Chat actions, their parameters, and which ask before they run.
ACTIONS = {"research": ("topic",), "show_review": (), "show_graph": (), "show_packs": (), "show_sources": (), "search_entities": ("query",), "enrich": (), "build_pack": ("name",), "status": (), "help": (), "unknown": ()}
CONFIRMED = {"build_pack"}


def read_intent(payload: dict) -> tuple[str, dict[str, str], bool]:
    """(action, its known parameters, whether to ask first)."""
    action = payload.get("action")
    action = action if action in ACTIONS else "unknown"
    given = payload.get("params") if isinstance(payload.get("params"), dict) else {}
    return action, {k: str(given[k]).strip() for k in ACTIONS[action] if str(given.get(k) or "").strip()}, action in CONFIRMED
