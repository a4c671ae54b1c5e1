"""Versions of the whole store: two writers, pinned readers, old layouts, schemas and artifacts."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from stemma.plans.graph_store import GraphStore
from stemma.plans.session import TABLES
from stemma.plans.snapshots import Change, SnapshotLog


def node(spark, i, status="proposed"):
    return spark.createDataFrame([(i, "T", i, i, [], {}, status, 0.5, None, None, 0.0)], TABLES["nodes"])


def test_two_writers_and_a_pinned_reader(spark, tmp_path):
    path = str(tmp_path / "store")
    a, b = GraphStore(spark, path), GraphStore(spark, path)
    a.append(nodes=node(spark, "x"))
    seen = b.open()
    tries, meet = [], threading.Barrier(2, timeout=60)

    def approve(g):
        tries.append(1)
        if len(tries) <= 2:
            meet.wait()  # both have read the same version
        return {"nodes": g.nodes.withColumn("status", F.lit("verified"))}

    def rename(g):
        tries.append(1)
        if len(tries) <= 2:
            meet.wait()
        return {"nodes": g.nodes.withColumn("name", F.lit("renamed"))}

    other = threading.Thread(target=lambda: b.change(rename))
    other.start()
    a.change(approve)
    other.join()
    row = a.open().nodes.first()
    assert (row["status"], row["name"]) == ("verified", "renamed") and len(tries) == 3  # one of them came second and tried again
    assert (seen.nodes.first()["status"], seen.nodes.first()["name"]) == ("proposed", "x")


def test_an_older_layout_is_read(spark, tmp_path):
    path = str(tmp_path / "store")
    SnapshotLog(spark, path, {"nodes": "id string, name string"}).update(lambda base: Change({"nodes": spark.createDataFrame([("old", "n")], "id string, name string")}))
    store = GraphStore(spark, path)
    store.append(nodes=node(spark, "new", "verified"))
    rows = {r["id"]: r for r in store.open().nodes.collect()}
    assert (rows["old"]["status"], rows["old"]["aliases"], rows["old"]["confidence"]) == ("proposed", [], None) and rows["new"]["status"] == "verified"
    assert store.open(1).nodes.count() == 1


def test_schemas_and_artifacts(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"), clock=lambda: 5.0)
    types = spark.createDataFrame([("Part",)], "name string")
    ends = lambda *rows: spark.createDataFrame(list(rows), "name string, domain_type string, range_type string")
    assert store.schema().count() == 0
    assert store.install_schema("a", "{}", types, ends(("uses", "Part", "*"))) == 1
    with pytest.raises(ValueError, match="Ghost"):
        store.install_schema("b", "{}", types, ends(("uses", "Ghost", "*")))
    assert store.install_schema("b", "{}", types, ends(("uses", "*", "*")), activate=False) == 2
    assert store.schema().first()["id"] == 1
    store.activate(2)
    assert store.schema().first()["id"] == 2
    with pytest.raises(ValueError):
        store.activate(9)
    assert [store.register_artifact("pack", "zip", p, "h") for p in ("p1", "p2")] == [1, 2]
    assert store.artifact("pack").first()["path"] == "p2" and store.artifact("pack", 1).first()["path"] == "p1" and store.artifact("none").count() == 0
