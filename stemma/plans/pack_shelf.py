"""Packs as they are shipped: verified graph, aliases, communities with summaries and a text index; loaded for reading.

A pack is a folder ``<shelf>/<name>`` of Parquet tables, an index and a manifest. The manifest is
written last, so a pack whose build broke off is never listed or loaded (its name stays taken).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, packs, search
from ..operators.graph import verified_subgraph, visible
from ..operators.text_index import TextIndex, build_index
from .checkpoints import cut
from .session import TABLES, Graph, PackSession, detect_communities

#: Tables of a pack beside those of a graph.
SHIPPED = {
    "aliases": "node_id string, surface string, normalized_alias string",
    "community_members": "id string, community_id string",
    "communities": "community_id string, member_count long, top_members string, summary string, summary_method string",
}


class NoPack(LookupError):
    """No finished pack has this name."""


def pack_contents(
    nodes: DataFrame,
    edges: DataFrame,
    citations: DataFrame,
    documents: DataFrame,
    aliases: DataFrame | None = None,
    method: str = "auto",
    resolution: float | None = None,
    summarize: Callable | None = None,
    summary_method: str = "extractive",
) -> dict[str, DataFrame]:
    """All tables that a pack ships, by name.

    ``pack_tables``, with the documents that shipped nodes and edges name as their own
    (``source_doc``, where there is such a column) beside the cited ones; the shipped nodes'
    aliases; communities of the shipped graph, found once here, with their members and summaries
    (``summarize`` turns an extracted summary into another one, ``summary_method`` says how).
    """
    tables = packs.with_cited(cut(visible(nodes)), cut(verified_subgraph(nodes, edges)), citations, documents)  # read many times below
    owners = [t.select(F.col("source_doc").alias("doc_id")) for t in (tables["nodes"], tables["edges"]) if "source_doc" in t.columns]
    wanted = tables["citations"].select("doc_id")
    for own in owners:
        wanted = wanted.unionByName(own)
    tables["documents"] = documents.join(wanted.distinct(), "doc_id", "left_semi")
    if aliases is None:
        from ..functions.text import normalize_name

        spread = tables["nodes"].select(F.col("id").alias("node_id"), F.explode("aliases").alias("surface"))
        tables["aliases"] = spread.withColumn("normalized_alias", normalize_name(F.col("surface")))
    else:
        tables["aliases"] = aliases.join(tables["nodes"].select(F.col("id").alias("node_id")), "node_id", "left_semi")
    tables["community_members"] = cut(detect_communities(tables["nodes"], tables["edges"], method, resolution).select("id", "community_id"))
    said = community.summaries(tables["nodes"], tables["edges"], tables["community_members"], summarize)
    tables["communities"] = said.withColumn("summary_method", F.lit(summary_method))
    return tables


class PackShelf:
    """The packs below ``path``; ``embed``, ``model`` and ``rerank`` go to the sessions that it loads."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[str], list[float]] | None = None, model: str | None = None, rerank: Callable[[DataFrame, str], DataFrame] | None = None):
        self.spark, self.path, self.serving = spark, path.rstrip("/"), (embed, model, rerank)

    def build(self, name: str, graph: Graph, created_ts: float, aliases: DataFrame | None = None, states: DataFrame | None = None, incomplete_because: str | None = None, **options) -> dict:
        """Write a new pack and return its manifest.

        ``states`` (``packs.completeness``) gates it; an incomplete extraction ships only where
        ``incomplete_because`` says why, and the manifest keeps the reason. ``options`` go to
        ``pack_contents``.
        """
        packs.check_name(name)
        why = (incomplete_because or "").strip()
        if incomplete_because is not None and not why:
            raise ValueError("shipping an incomplete extraction needs a reason")
        gate = packs.completeness_summary(states) if states is not None else None
        if gate and gate["status"] == "incomplete" and not why:
            raise packs.Incomplete(f"{gate['unknown']} streams unknown, {gate['incomplete']} incomplete")
        tables = pack_contents(graph.nodes, graph.edges, graph.citations, graph.documents, aliases, **options)
        tables["nodes"].limit(0).write.mode("error").parquet(f"{self.path}/{name}/claim")  # of two builders one goes on
        build_index(tables["nodes"].withColumn("_body", search.node_text(tables["nodes"])), "id", "_body", f"{self.path}/{name}/index")
        notes = {"override": why if gate and gate["status"] == "incomplete" else None}
        return packs.build_pack(self.spark, self.path, name, tables, created_ts, states, bool(why), notes)

    def list(self) -> DataFrame:
        """name, created_ts, counts, content_hash of the finished packs, the newest first; none where there is no shelf yet."""
        if not self._names():
            return self.spark.createDataFrame([], "name string, created_ts double, counts map<string,long>, content_hash string")
        return packs.list_packs(self.spark, self.path)

    def _names(self) -> list[str]:
        """Finished packs: those with a manifest."""
        jvm, settings = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/manifest/_SUCCESS")
        found = pattern.getFileSystem(settings).globStatus(pattern) or []
        return sorted(f.getPath().getParent().getParent().getName() for f in found)

    def manifest(self, name: str) -> dict:
        packs.check_name(name)
        if name not in self._names():
            raise NoPack(name)
        return json.loads(self.spark.read.text(f"{self.path}/{name}/manifest").first()["value"])

    def load(self, name: str) -> PackSession:
        """A session over one pack, which later packs don't change."""
        manifest = self.manifest(name)
        read = lambda t: self.spark.read.parquet(f"{self.path}/{name}/{t}")
        graph = Graph(**{t: read(t) for t in TABLES})
        shipped = {t: self.spark.read.schema(ddl).parquet(f"{self.path}/{name}/{t}") for t, ddl in SHIPPED.items()}
        index = TextIndex(self.spark, f"{self.path}/{name}/index", dict(graph.nodes.dtypes)["id"])
        return PackSession(graph, *self.serving, pack={"pack_id": name, "content_hash": manifest["content_hash"]}, shipped=shipped, index=index)

    def autoload(self) -> PackSession | None:
        """The shelf's only pack; None where it has none or several."""
        names = self._names()
        return self.load(names[0]) if len(names) == 1 else None
