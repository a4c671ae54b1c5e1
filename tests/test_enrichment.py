"""Lookup passes, decisions and hints in odd cases."""

import json

import pytest
from pyspark.sql import functions as F

from stemma.operators import enrichment as E

NODES = "id string, entity_type string, name string, status string, created_ts double, verified_ts double, properties map<string,string>"
ANSWERS = "resource string, name string, external_id string, record_url string, matched_name string, facts map<string,string>, error string"


def _nodes(spark):
    rows = [("a", "Gene", "TP53", "verified", 5.0, 1.0, {"k": "v"}), ("b", "Gene", "BRCA1", "verified", 2.0, None, None), ("c", "Gene", "not a symbol at all", "verified", 3.0, None, None), ("d", "Gene", None, "verified", None, None, None), ("e", "Gene", "EGFR", "proposed", 0.0, None, None)]
    return spark.createDataFrame(rows, NODES)


def _run(spark, answers, old=(), **options):
    got = E.enrich(_nodes(spark), spark.createDataFrame(list(old), E.ANNOTATIONS), spark.createDataFrame(answers, ANSWERS), 7.0, **options)
    return [{(r["node_id"], r["resource"]): r for r in got[0].collect()}, got[1].first().asDict(), sorted(map(tuple, got[2].collect()))]


def test_pass(spark):
    answers = [
        ("uniprot", "TP53", "P2", "u", "tp53", {"f": "2"}, None),
        ("uniprot", "TP53", "P1", "u", "tp53", {"f": "1"}, None),  # the least of two
        ("uniprot", "TP53", "P0", None, None, None, "timeout"),  # an error beside an answer
        ("mygene", "TP53", None, None, None, None, "HTTPError"),
        ("uniprot", "BRCA1", None, None, None, None, None),
        ("mygene", "BRCA1", "9", None, None, None, None),
        ("uniprot", "EGFR", "E", None, None, None, None),
    ]
    old = [("b", "mygene", "old", None, None, None, "rejected", 1.0, 2.0, "me", "no"), ("a", "uniprot", "old", None, None, None, "proposed", 1.0, None, None, None), ("gone", "uniprot", "z", None, None, None, "verified", 1.0, 2.0, "me", None)]
    rows, report, failures = _run(spark, answers, old, resources=["uniprot", "mygene"])
    assert report == {"nodes_considered": 4, "skipped_decided": 1, "skipped_shape": 4, "lookups": 3, "failed": 1, "missed": 1, "matched": 1, "proposed": 0, "refreshed": 1}
    assert failures == [("mygene", "TP53", "HTTPError")]
    assert set(rows) == {("a", "uniprot"), ("b", "mygene"), ("gone", "uniprot")}
    a = rows["a", "uniprot"]
    assert (a["external_id"], a["facts"], a["status"], a["created_ts"]) == ("P1", {"f": "1"}, "proposed", 7.0)
    assert rows["b", "mygene"]["external_id"] == "old" and rows["b", "mygene"]["created_ts"] == 1.0
    rows, report, _ = _run(spark, answers[:2], limit=1)  # nulls come first: the node without times
    assert (report["nodes_considered"], report["skipped_shape"]) == (1, 4)
    rows, report, _ = _run(spark, answers[:2], limit=2)
    assert (report["nodes_considered"], report["proposed"], set(rows)) == (2, 1, {("a", "uniprot")})
    rows, report, _ = _run(spark, [])
    assert (rows, report["missed"]) == ({}, 8)
    with pytest.raises(ValueError, match="wiki"):
        _run(spark, [], resources=["wiki"])


def test_decide(spark):
    old = [("a", "uniprot", "P1", "u", "tp53", {"f": "1", "matched_name": "own"}, "proposed", 3.0, None, None, None), ("a", "mygene", "9", None, None, None, "proposed", 2.0, None, None, None), ("b", "uniprot", "B", None, None, None, "proposed", 1.0, None, None, None), ("b", "mygene", "C", None, None, None, "verified", 1.0, 2.0, "me", None)]
    notes = spark.createDataFrame(old, E.ANNOTATIONS)
    decisions = spark.createDataFrame([("a", "uniprot", True, "me", "n", 5.0), ("a", "uniprot", False, "me", "n", 6.0), ("b", "uniprot", False, "you", None, 5.0), ("b", "mygene", False, "you", None, 5.0), ("zz", "uniprot", True, "me", None, 5.0), ("a", "mygene", True, "me", None, 5.0)], "node_id string, resource string, accept boolean, by string, note string, ts double")
    assert [r["node_id"] for r in E.pending_annotations(notes, _nodes(spark), 2).collect()] == ["b", "a"]
    after, nodes = E.decide(notes, _nodes(spark), decisions)
    got = {(r["node_id"], r["resource"]): (r["status"], r["decided_by"], r["decided_ts"]) for r in after.collect()}
    assert got == {("a", "uniprot"): ("verified", "me", 5.0), ("a", "mygene"): ("verified", "me", 5.0), ("b", "uniprot"): ("rejected", "you", 5.0), ("b", "mygene"): ("verified", "me", 2.0)}
    held = {r["id"]: r["properties"] for r in nodes.collect()}
    assert held["b"] is None and set(held["a"]) == {"k", "uniprot", "mygene"}
    assert json.loads(held["a"]["uniprot"]) == {"external_id": "P1", "record_url": "u", "matched_name": "own", "f": "1"}
    assert json.loads(held["a"]["mygene"])["external_id"] == "9"
    assert tuple(E.annotation_counts(after).first()) == (0, 3, 1) and tuple(E.annotation_counts(after.limit(0)).first()) == (0, 0, 0)


def test_hints(spark):
    of = lambda *rows: spark.createDataFrame(rows, "node_id string, registry string, accession string, error string, fetched_ts double")
    old = of(("a", "uniprot", "P1", None, 9.0), ("a", "pubchem", "1", None, 1.0))
    new = of(("a", "uniprot", "", "timeout", 2.0), ("a", "uniprot", "P3", None, 3.0), ("b", "uniprot", "P4", None, None))
    both = E.upsert_hints(old, new)
    assert [tuple(r) for r in E.list_hints(both, "a").collect()] == [("a", "uniprot", "P3", None, 3.0), ("a", "pubchem", "1", None, 1.0)]
    assert both.where("node_id = 'b'").first()["accession"] == "P4" and both.columns == old.columns
    assert E.upsert_hints(old.limit(0), new.limit(0)).count() == 0
