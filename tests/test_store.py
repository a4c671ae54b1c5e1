"""Writes over all frames of a store, streams and gates, phrases and written indexes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import community, graph, packs, quality, resolve, review, search, store

NODES = "id string, entity_type string, name string, normalized_name string, aliases array<string>, properties map<string,string>, status string, embedding array<float>, embedding_model string"
EDGES = "id string, relation_type string, src string, dst string, status string, invalidated_ts double"


@pytest.fixture(scope="module")
def small(spark):
    n = [("a", "T", "Salt Pan", "saltpan", ["Pan"], {"k": "1"}, "verified", [1.0], "m"), ("b", "T", "Brine Pool", "brinepool", ["Pool"], {"k": "2", "z": "3"}, "proposed", [1.0], "m"), ("c", "T", "Weir", "weir", [], {}, "verified", None, None), ("d", "U", "Weir", "weir", [], {}, "verified", None, None)]
    e = [("ab", "r", "a", "b", "verified", None), ("bc", "r", "b", "c", "proposed", None), ("ac", "r", "a", "c", "verified", None), ("cb", "r", "c", "b", "proposed", None), ("old", "r", "b", "c", "verified", 1.0)]
    aliases = [("a", "pan", "Pan"), ("b", "pool", "Pool"), ("b", "lagoon", "Lagoon")]
    cites = [("node", "a", 1, 0, 4), ("node", "b", 2, 0, 4), ("edge", "bc", 3, 0, 4)]
    pairs = [("a", "b", "proposed", None, None), ("b", "c", "proposed", None, None), ("a", "c", "proposed", None, None)]
    make = spark.createDataFrame
    return store.Store(make(n, NODES), make(e, EDGES), make(aliases, "node_id string, normalized_alias string, surface string"), make(cites, "kind string, item_id string, doc_id long, start int, end int"), make(pairs, "a string, b string, status string, decided_by string, decided_ts double"))


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_merge_touches_every_frame(small):
    after, report = store.merge_store(small, "a", "b", by="ann", ts=5.0)
    n = by(after.nodes, "id")
    assert n[("a",)]["aliases"] == ["Pan", "Brine Pool", "Pool", "Lagoon"] and n[("a",)]["properties"] == {"k": "1", "z": "3"} and n[("a",)]["embedding"] is None
    assert (n[("b",)]["status"], n[("b",)]["review_note"]) == ("rejected", "merged-into:a") and n[("c",)]["status"] == "verified"
    e = {r["id"]: (r["src"], r["dst"], r["status"]) for r in after.edges.collect()}
    assert e == {"ab": ("a", "b", "rejected"), "bc": ("b", "c", "rejected"), "ac": ("a", "c", "verified"), "cb": ("c", "a", "proposed"), "old": ("b", "c", "verified")}
    assert set(by(after.aliases, "node_id", "normalized_alias")) == {("a", k) for k in ("pan", "pool", "lagoon", "brinepool")}
    assert sorted((r["kind"], r["item_id"]) for r in after.citations.collect()) == [("edge", "ac"), ("node", "a"), ("node", "a")]
    c = by(after.candidates, "a", "b")
    assert [c[k]["status"] for k in (("a", "b"), ("b", "c"), ("a", "c"))] == ["merged", "stale", "proposed"] and c[("b", "c")]["decided_by"] == "system:merge-by:ann"
    assert tuple(report.first()) == (1, 1, 1)
    with pytest.raises(ValueError, match="verified"):
        store.merge_store(small, "b", "a")
    with pytest.raises(ValueError):
        store.merge_store(small, "c", "d")


def sequential(known, aliases, entities):
    """Bindings one mention after the other."""
    exact, alias, out = {}, {}, {}
    for k, key in sorted(known):
        exact.setdefault(key, k)
    for k, key in sorted(aliases):
        alias.setdefault(key, k)
    for seq, name, more in entities:
        key = name.lower()
        owner = exact.get(key) or alias.get(key)
        for a in [*([key] if owner else []), *map(str.lower, more)]:
            alias.setdefault(a, owner or f"e{seq}")
        if owner is None:
            owner = exact[key] = f"e{seq}"
        out[f"e{seq}"] = owner
    return out


def test_proposals_bind_in_order(spark, small):
    rng = random.Random(7)
    names = [f"Name{i:02}x" for i in range(14)]
    said = [(s, rng.choice(names), rng.sample(names, rng.choice([0, 0, 1, 2]))) for s in range(60)]
    known = [(f"k{i}", names[i].lower()) for i in (0, 3)]
    n = spark.createDataFrame([(k, "T", key, key, [], {}, "verified", None, None) for k, key in known], NODES)
    a = spark.createDataFrame([("k0", names[5].lower(), names[5])], "node_id string, normalized_alias string, surface string")
    st = store.Store(n, small.edges.limit(0), a, small.citations.limit(0))
    e = spark.createDataFrame([(s, f"e{s}", "T", x, more, {"first": str(s)}, 0.5, 9, 0, 1, s % 2 == 0) for s, x, more in said], "seq long, id string, entity_type string, name string, aliases array<string>, properties map<string,string>, confidence double, doc_id long, start int, end int, synthesized boolean").repartition(3)
    r = spark.createDataFrame([(1, "r1", "uses", "e0", "e1", 0.5, 9, 0, 1), (2, "r2", "uses", "e0", "e1", 0.5, 9, 0, 1)], "seq long, id string, relation_type string, src string, dst string, confidence double, doc_id long, start int, end int")
    after, id_map, stats = store.insert_proposed(st, e, r)
    want = sequential(known, [("k0", names[5].lower())], said)
    assert {x["id"]: x["node_id"] for x in id_map.collect()} == want
    nodes = by(after.nodes, "id")
    minted = {k for k, v in want.items() if k == v}
    assert set(nodes) == {("k0",), ("k3",)} | {(k,) for k in minted}
    for key, row in nodes.items():
        keys = [x.lower() for x in row["aliases"] if x.lower() != row["normalized_name"]]
        first = [s for s, _, _ in said if want[f"e{s}"] == key[0]]
        assert len(set(keys)) >= len(keys) - 1 and (not first or row["properties"]["first"] == str(first[0]))
    got = stats.first()
    assert (got["nodes_new"], got["nodes_merged"], got["edges_new"], got["edges_merged"], got["synthesized_endpoints"]) == (len(minted), 60 - len(minted), 1, 1, 30)
    assert after.citations.count() == 62 and after.edges.first()["id"] == "r1"
    bad = r.withColumn("src", F.lit("nobody"))
    with pytest.raises(Exception, match="unknown end"):
        store.insert_proposed(st, e, bad)


def test_bootstrap_draws_are_the_generator_s():
    for tp, fp, fn in ((5, 2, 1), (40, 3, 0), (0, 2, 2), (130, 70, 60)):
        rng, total, scores = random.Random(7), tp + fp + fn, []
        for _ in range(2000):
            drawn = [rng.randrange(total) for _ in range(total)]
            hit = sum(x < tp for x in drawn)
            scores.append(2 * hit / (2 * hit + total - hit))
        scores.sort()
        assert quality.bootstrap_f1(tp, fp, fn) == (round(scores[50], 4), round(scores[1949], 4))
    assert quality.bootstrap_f1(0, 0, 0) == (1.0, 1.0)


def test_phrases_folding_and_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Réservoir of salt water", "pan"), (2, "water salt", "reservoir"), (3, "salt", "water"), (4, None, "nothing")], "k long, t string, u string")
    keys = lambda q, c="t": sorted(r["key"] for r in search.bm25(rows, "k", c, q).collect())
    assert keys("reservoir") == [1] and keys("salt_water") == [1] and keys("RÉSERVOIR", ["t", "u"]) == [1, 2]
    assert keys("salt_water", ["t", "u"]) == [1]  # no phrase runs from one column into the next


def test_gate(spark, tmp_path):
    streams = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "doc_id long, engine string")
    runs = spark.createDataFrame([(10, 1, "x", "complete"), (11, 2, "x", "failed")], "run_id long, doc_id long, engine string, status string")
    chunks = spark.createDataFrame([(11, "pending")], "run_id long, status string")
    states = packs.completeness(streams, runs, chunks)
    assert {r["doc_id"]: r["state"] for r in states.collect()} == {1: "satisfied", 2: "incomplete", 3: "unknown"}
    n = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(packs.Incomplete):
        packs.build_pack(spark, str(tmp_path), "p", {"nodes": n}, 1.0, states)
    assert packs.build_pack(spark, str(tmp_path), "p", {"nodes": n}, 1.0, states, allow_incomplete=True)["completeness"] == {"status": "incomplete", "streams": 3, "unknown": 1, "incomplete": 1}
    assert packs.completeness_summary(states.limit(0))["status"] == "not_applicable"


def test_diff_of_lists(spark):
    kind = "id string, name string, aliases array<string>, properties map<string,string>"
    old = spark.createDataFrame([("a", "x", ["p", "q"], {"k": "1", "l": "2"}), ("b", "y", ["p"], {})], kind)
    new = spark.createDataFrame([("a", "x", ["q", "p"], {"l": "2", "k": "1"}), ("b", "y", ["p", "q"], {})], kind)
    assert [tuple(r) for r in packs.diff(old, new, ["aliases", "name", "properties"], "name").collect()] == [("b", "changed", "aliases", "y")]
    assert packs.manifest_changes({"a": 1, "b": 2}, {"a": 1, "b": 3}, ["a", "b"]) == {"b": (2, 3)}
    row = packs.staleness(None, new, ["name"]).first()
    assert (row["pack_items"], row["live_items"], row["pending"], row["additions"]) == (None, 2, None, None)


def test_a_component_too_large_for_a_task_goes_by_joins(spark):
    n = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d")], "id string, src string, dst string")
    labels = lambda **o: sorted(map(tuple, community.label_propagation(n, e, **o).collect()))
    assert labels(most_edges=2) == labels()


def test_nested_projection_and_vectors(spark):
    rows = spark.createDataFrame([("a", '["x"]', '{"k":"v"}', '{"start":1,"end":2}'), ("b", "junk", None, None)], "id string, aliases_json string, properties_json string, source_span string")
    got = {r["id"]: r for r in graph.project_nodes(rows).collect()}
    assert got["a"]["aliases"] == ["x"] and got["a"]["properties"] == {"k": "v"} and got["a"]["span"]["end"] == 2 and got["b"]["aliases"] is None
    v = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>").select(search.unpack_vector(search.pack_vector(F.col("v"))).alias("v"))
    assert [r["v"] for r in v.collect()] == [[1.5, -2.0], None, []]


def test_scan_stats(spark):
    n = spark.createDataFrame([(str(i), "T", f"name{i}", "verified") for i in range(5)], "id string, entity_type string, normalized_name string, status string")
    pairs = spark.createDataFrame([("0", "1"), ("2", "3")], "a string, b string")
    row = resolve.scan_stats(n, pairs, pairs.limit(1)).first()
    assert (row["nodes"], row["pairs_checked"], row["candidates"], row["share"]) == (5, 2, 1, 0.2)


def test_linked_sets_of_proposals_are_walked_in_one_pass(spark):
    """Known nodes come before all mentions, whatever the sequence numbers; no set is a call of its own."""
    nodes = spark.createDataFrame([("N1", "T", "alpha", "verified"), ("N2", "T", "beta", "verified"), ("N3", "T", "lost", "rejected")], "id string, entity_type string, normalized_name string, status string")
    aliases = spark.createDataFrame([("N2", "gamma", "Gamma")], "node_id string, normalized_alias string, surface string")
    said = [(-5, "m0", "T", "Alpha", ["delta"]), (-4, "m1", "T", "Delta", []), (-3, "m2", "T", "Gamma", []), (-2, "m3", "U", "Alpha", []), (-1, "m4", "T", "Lost", ["omega"]), (0, "m5", "T", "Omega", []), (1, "m6", "U", "Alpha", ["other"])]
    entities = spark.createDataFrame(said, "seq long, id string, entity_type string, name string, aliases array<string>")
    bound = store.bind_entities(store.Store(nodes, None, aliases, None), entities)
    assert "FlatMapGroupsIn" not in bound._jdf.queryExecution().toString()
    assert {r["id"]: (r["node_id"], r["minted"]) for r in bound.collect()} == {"m0": ("N1", False), "m1": ("N1", False), "m2": ("N2", False), "m3": ("m3", True), "m4": ("m4", True), "m5": ("m4", False), "m6": ("m3", False)}


def in_parts(edges, n=5):
    """The same edges as a union, as where a store is derived from several tables."""
    parts = [edges.where(F.pmod(F.hash("id"), F.lit(n)) == i) for i in range(n)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_a_merge_compares_only_edges_at_its_two_nodes(small):
    """All edges went through a join on (relation, ends), so a task's sorts grew with the store."""
    want = by(store.repoint_edges(small.edges, "a", "b"), "id")
    split = store.repoint_edges(in_parts(small.edges), "a", "b")
    assert by(split, "id") == want and {want[i]["outcome"] for i in [("ab",), ("bc",), ("cb",), ("old",)]} == {"self_loop", "duplicate", "repointed", None}
    assert joins(split) == 0


def test_bulk_approval_joins_only_what_it_may_change(small):
    """Joins by id ran over all edges, one for each table they came from, in one task."""
    sure = in_parts(small.edges.withColumn("confidence", F.when(F.col("id") != "cb", 0.9)))
    nodes = small.nodes.withColumn("confidence", F.lit(0.9))
    n, e = review.bulk_approve(nodes, sure, min_confidence=0.5)
    assert {r["status"] for r in n.collect()} == {"verified"}
    assert {r["id"]: r["status"] for r in e.collect()} == {"ab": "verified", "bc": "verified", "ac": "verified", "cb": "proposed", "old": "verified"}
    assert joins(e) == 2
