"""Answers, gold files, critic answers, snapshots and the read session."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stemma.operators import extraction as X
from stemma.plans import session as S
from stemma.plans.shipping import ship

SCHEMA = {"entities": {"Component": {"tier": ["gold", "iron"], "note": []}, "Person": {}}, "relations": {"uses": ("Component", "Component"), "knows": ("*", "*")}}
TEXT = "The salt-sampler uses RiverSluice daily."


def answer(**payload):
    return "```json\n" + json.dumps(payload) + "\n```"


def test_locate():
    assert X.locate(TEXT, "riversluice") == (22, 33)
    assert X.locate(TEXT, "SaltSampler") == (4, 16)
    assert X.locate(TEXT, "absent") is None and X.locate(TEXT, "??") is None


def test_answers(spark):
    ship(spark)
    a = answer(
        entities=[
            {"name": "SaltSampler", "entity_type": "Component", "confidence": 7, "properties": {"tier": "gold", "x": "y"}, "source_span": {"start": 0, "end": 3}},
            {"name": "salt-sampler", "entity_type": "Component", "aliases": ["Sampler"]},
            {"name": "Ghost", "entity_type": "Component"},
            {"name": "RiverSluice", "entity_type": "Nope"},
        ],
        relations=[
            {"relation_type": "uses", "source": {"name": "SaltSampler", "entity_type": "Component"}, "target": {"name": "RiverSluice", "entity_type": "Component"}},
            {"relation_type": "uses", "source": {"name": "SaltSampler", "entity_type": "Component"}, "target": {"name": "Bob", "entity_type": "Person"}},
            {"relation_type": "zzz"},
        ],
    )
    df = spark.createDataFrame([(1, 100, TEXT, a), (2, 0, TEXT, "nothing"), (3, 0, TEXT, None)], "doc_id long, char_offset int, text string, answer string")
    rows = X.parse_answers(df, SCHEMA).collect()
    first = {r["name"]: r for r in rows if r["doc_id"] == 1 and r["kind"] == "entity"}
    assert set(first) == {"SaltSampler", "RiverSluice", "Bob"}
    e = first["SaltSampler"]
    assert (e["start"], e["end"], e["confidence"], e["properties"], e["aliases"]) == (104, 116, 1.0, {"tier": "gold"}, ["Sampler"])
    assert first["RiverSluice"]["synthesized"] and first["RiverSluice"]["start"] == 122 and first["Bob"]["start"] is None
    assert [(r["src"], r["dst"]) for r in rows if r["kind"] == "relation"] == [("SaltSampler", "RiverSluice")]
    assert [r["doc_id"] for r in rows if r["doc_id"] > 1] == [2, 3]


def test_gold_and_critic(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"entities": [{"name": "A-long name"}], "triples": [{"src": "Aaaa", "relation": "uses", "dst": "Bbbb"}]}))
    e, t = X.load_gold(spark, str(tmp_path / "gold.json"))
    assert e.collect()[0]["name"] == "alongname" and tuple(t.collect()[0]) == ("aaaa", "uses", "bbbb")
    (tmp_path / "bad.json").write_text(json.dumps({"entities": [{}], "triples": []}))
    with pytest.raises(Exception, match="without a field"):
        X.load_gold(spark, str(tmp_path / "bad.json"))[0].collect()
    answers = spark.createDataFrame([('```json\n[{"id":"a","score":1.7,"rationale":"r"},{"id":"zz","score":0.1},{"id":"b"}]\n```',), ("junk",)], "answer string")
    items = spark.createDataFrame([("a", 0.2, True), ("b", None, False)], "id string, confidence double, cited boolean")
    scored = X.parse_critic(answers, items)
    assert [tuple(r) for r in scored.collect()] == [("a", 1.0, "r")]
    assert tuple(X.critic_stats(items, scored).first()) == (2, 1, 1, 1)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    from stemma.operators.search import hash_embedding

    ship(spark)
    rows = [("a", "T", "Salt Sampler", "saltsampler", ["Brine"], {"k": "v"}, "verified", 0.9), ("b", "T", "River Sluice", "riversluice", [], {}, "verified", None), ("c", "T", "Hidden", "hidden", [], {}, "rejected", 0.1)]
    n = spark.createDataFrame(rows, "id string, entity_type string, name string, normalized_name string, aliases array<string>, properties map<string,string>, status string, confidence double").withColumn("embedding", hash_embedding("name")).withColumn("embedding_model", F.lit("hash")).withColumn("created_ts", F.lit(1.0))
    e = spark.createDataFrame([("ab", "uses", "a", "b", "verified", 0.5, None, 1.0)], S.TABLES["edges"])
    c = spark.createDataFrame([("node", "a", 1, 0, 4)], S.TABLES["citations"])
    d = spark.createDataFrame([(1, "Salt sampler text", "s", 1.0)], S.TABLES["documents"])
    path = str(tmp_path_factory.mktemp("graph") / "snap")
    S.Graph(n, e, c, d).save(path)
    return S.Graph.open(spark, path), path


def test_session(loaded, tmp_path):
    from stemma.operators.search import hash_vector

    g, path = loaded
    s = S.PackSession(g)
    found, tier = s.semantic_search("sampler")
    assert tier == "fts5" and [r["key"] for r in found.collect()] == ["a"]
    found, tier = S.PackSession(g, hash_vector, "hash").semantic_search("RiverSluice", expand=True)
    assert tier == "fts5+vec-rrf+llm-expansion" and found.orderBy("rank").first()["key"] == "b"
    assert s.entity_lookup("brine").first()["id"] == "a"
    assert [r["node_id"] for r in s.find_path("a", "b").orderBy("step").collect()] == ["a", "b"]
    row = s.get_entity("a").first()
    assert row["relations"][0]["far_name"] == "River Sluice" and row["mentions"][0]["excerpt"].startswith(">>>Salt<<<")
    assert s.communities().count() == 1 and g.list_documents().count() == 1
    S.bundle(path, str(tmp_path / "x.zip"))
    assert (tmp_path / "x.zip").stat().st_size > 500


def test_driver_side_helpers(loaded):
    assert S.formulate_query(answer(query="a b c d e f g h")) == "a b c d e f"
    assert S.formulate_query("nothing") is None and S.formulate_query(answer(query="x" * 121)) is None
    assert S.read_intent({"action": "build_pack", "params": {"name": " p ", "z": 1}}) == ("build_pack", {"name": "p"}, True)
    assert S.read_intent({"action": "rm"}) == ("unknown", {}, False)
    g, _ = loaded
    with pytest.raises(ValueError, match="louvain"):
        S.detect_communities(g.nodes, g.edges, "louvain")
    with pytest.raises(ValueError):
        S.detect_communities(g.nodes, g.edges, "cpm")
