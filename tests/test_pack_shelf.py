"""Packs with aliases, communities and an index: built, listed, loaded, asked."""

import pytest
from pyspark.sql import functions as F

from stemma.operators import community, packs
from stemma.plans import pack_shelf, testbed
from stemma.plans import session as S
from stemma.plans.pack_shelf import NoPack, PackShelf, pack_contents
from stemma.plans.shipping import ship

from .conftest import DATA

NODES = "id string, entity_type string, name string, normalized_name string, aliases array<string>, properties map<string,string>, status string, confidence double, source_doc long, created_ts double"


@pytest.fixture(scope="module")
def graph(spark):
    ship(spark)
    rows = [(f"{g}{i}", "T", f"{g.upper()} item {i}", f"{g}item{i}", ["Brine", f"{g} other"] if i == 0 else [], {"use": f"{g}pump"}, "verified", 0.9, i, 1.0) for g in "ab" for i in range(4)]
    rows += [("x", "T", "Hidden pump", "hiddenpump", ["Brine"], {}, "rejected", 0.1, 9, 1.0), ("p", "T", "Proposed", "proposed", None, None, "proposed", None, 8, 1.0)]
    n = spark.createDataFrame(rows, NODES)
    ways = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "x"), ("b0", "p")]
    e = spark.createDataFrame([(f"{a}-{b}", "near", a, b, "verified", 0.5, None, 1.0) for a, b in ways] + [("old", "near", "a0", "b0", "verified", 0.5, 3.0, 1.0)], S.TABLES["edges"])
    c = spark.createDataFrame([("node", "a0", 5, 0, 4), ("node", "x", 6, 0, 4), ("edge", "a1-a0", 7, 0, 2), ("node", "a0", 4, 1, 2)], S.TABLES["citations"])
    d = spark.createDataFrame([(i, f"text of {i}", "s", float(i)) for i in range(10)], S.TABLES["documents"])
    return S.Graph(n, e, c, d)


@pytest.fixture(scope="module")
def shelf(spark, graph, tmp_path_factory):
    s = PackShelf(spark, str(tmp_path_factory.mktemp("shelf")))
    assert s.list().count() == 0 and s.autoload() is None
    s.build("first", graph, 1.0)
    return s


def test_contents(spark, graph):
    t = pack_contents(graph.nodes, graph.edges, graph.citations, graph.documents)
    ids = lambda name, c="id": sorted(r[c] for r in t[name].collect())
    assert ids("nodes") == [f"{g}{i}" for g in "ab" for i in range(4)]
    assert len(ids("edges")) == 12 and "old" not in ids("edges")
    assert ids("documents", "doc_id") == [0, 1, 2, 3, 4, 5, 7]  # own ones of nodes, cited ones of what is shipped
    assert sorted(map(tuple, t["aliases"].collect())) == [("a0", "Brine", "brine"), ("a0", "a other", "aother"), ("b0", "Brine", "brine"), ("b0", "b other", "bother")]
    members = {r["id"]: r["community_id"] for r in t["community_members"].collect()}
    assert len(members) == 8 and {members[f"a{i}"] for i in range(4)} == {"community-000"} and {members[f"b{i}"] for i in range(4)} == {"community-001"}
    assert [(r["member_count"], r["summary_method"]) for r in t["communities"].collect()] == [(4, "extractive")] * 2
    named = spark.createDataFrame([("a1", "own", "own"), ("x", "gone", "gone")], "node_id string, surface string, normalized_alias string")
    t = pack_contents(graph.nodes, graph.edges, graph.citations, graph.documents, named, "cpm", 0.5, lambda text: F.concat(F.lit("About "), text), "model")
    assert [r["node_id"] for r in t["aliases"].collect()] == ["a1"]
    assert {r["summary_method"] for r in t["communities"].collect()} == {"model"} and all(r["summary"].startswith("About 4 entities") for r in t["communities"].collect())


def test_empty_graph(spark, graph):
    t = pack_contents(graph.nodes.limit(0), graph.edges.limit(0), graph.citations.limit(0), graph.documents)
    assert {name: rows.count() for name, rows in t.items()} == dict.fromkeys(t, 0)


def test_load_and_ask(shelf, graph):
    s = shelf.autoload()
    assert s.pack == {"pack_id": "first", "content_hash": shelf.manifest("first")["content_hash"]}
    assert shelf.manifest("first")["counts"]["communities"] == 2
    a = s.answer("apump", k=2)
    assert (a.query, a.search_tier, a.expansion_terms, a.expansion_error, a.detail, a.pack) == ("apump", "fts5", [], None, False, s.pack)
    rows = a.results.collect()
    assert [r["id"] for r in rows] == ["a1", "a2"] and rows[0]["snippet"] == "use: apump"
    assert s.answer("apump", k=9, detail=True).results.where("status = 'verified'").count() == 4
    without = S.PackSession(s.graph)
    for q in ("pump", "item 2", "Brine other"):  # the shipped index gives what a scan gives
        got, want = (sorted((r["key"], round(r["score"], 9)) for r in x._scores(q).collect()) for x in (s, without))
        assert got == want
    assert [r["community_id"] for r in s.communities(1).collect()] == ["community-000"] and s.communities().count() == 2
    assert [r["id"] for r in s.community_members("community-001").collect()] == ["b0", "b1", "b2", "b3"]
    for asked in (s, without):
        with pytest.raises(community.UnknownCommunity):
            asked.community_members("community-999")


def test_lookup(shelf):
    s = shelf.load("first")
    by = lambda *a, **o: [(r["id"], r["tier"]) for r in s.entity_lookup(*a, **o).collect()]
    assert by("A  item 0")[0] == ("a0", 1)
    assert by("brine")[:2] == [("a0", 2), ("b0", 2)]
    assert by("bpump") == [("b1", 3), ("b2", 3), ("b3", 3), ("b0", 3)]  # by a property
    assert by("bpump", fuzzy=False) == [] and by("bpump", limit=1) == [("b1", 3)]
    assert by(id="a3") == [("a3", 1)] and by(id="x") == []
    row = s.entity_lookup(id="a0", detail=True).first()
    assert row["source_documents"] == [4, 5] and row["aliases"] == ["Brine", "a other"]
    assert s.entity_lookup(id="a1", detail=True).first()["source_documents"] == [1]
    with pytest.raises(ValueError, match="id or a name"):
        s.entity_lookup()


def test_provenance(spark, shelf):
    reviews = spark.createDataFrame([("node", "a2", "e", "m", "p", 0.25, 1.0, 1), ("node", "a2", "e", "m", "p", 0.5, 2.0, 2)], "kind string, item_id string, engine string, model string, prompt_version string, score double, created_ts double, seq long")
    s = shelf.load("first")
    r = s.provenance("node", "a2", reviews).first()
    assert (r["label"], r["document"]["doc_id"], r["document"]["title"], r["span"], r["excerpt"], r["critic"]["score"]) == ("A item 2", 2, None, None, None, 0.5)
    assert s.provenance("edge", "a1-a0", reviews).first()["critic"] is None and s.provenance("node", "zz", reviews).isEmpty()
    with pytest.raises(ValueError):
        s.provenance("document", "1", reviews)


def test_several_packs_and_names(spark, shelf, graph):
    states = spark.createDataFrame([("1", "satisfied"), ("2", "unknown")], "doc_id string, state string")
    with pytest.raises(packs.Incomplete):
        shelf.build("second", graph, 2.0, states=states)
    with pytest.raises(ValueError, match="reason"):
        shelf.build("second", graph, 2.0, states=states, incomplete_because=" ")
    made = shelf.build("second", graph, 2.0, states=states, incomplete_because="a source is late")
    assert made["override"] == "a source is late" and made["completeness"]["status"] == "incomplete"
    assert made["content_hash"] == shelf.manifest("first")["content_hash"]
    assert [r["name"] for r in shelf.list().collect()] == ["second", "first"] and shelf.autoload() is None
    with pytest.raises(Exception, match="(?i)exist"):
        shelf.build("second", graph, 3.0)
    for name in ("..", ".", "a/b", ""):
        with pytest.raises(ValueError):
            shelf.load(name)
    with pytest.raises(NoPack):
        shelf.load("third")
    graph.nodes.limit(0).write.parquet(f"{shelf.path}/broken/nodes")  # a build that broke off
    with pytest.raises(NoPack):
        shelf.load("broken")


def test_citations_are_chosen_by_the_stored_graph(spark, monkeypatch):
    """The verified edges were derived once more for the citations and documents of a pack."""
    monkeypatch.setattr(pack_shelf, "detect_communities", lambda nodes, *_: nodes.select("id", F.col("id").alias("community_id")))
    n, e = testbed.nodes(spark, DATA), testbed.edges(spark, DATA)
    cited = n.select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), F.col("source_doc").alias("doc_id"))
    t = pack_contents(n, e, cited, testbed.table(spark, DATA, "documents").select("doc_id"), n.limit(0).selectExpr("id AS node_id", "name AS surface", "name AS normalized_alias"))
    assert not [f for f in t["citations"].inputFiles() + t["documents"].inputFiles() if "lineitem" in f]
    assert t["citations"].count() == t["nodes"].count() > 0
