"""Label propagation by joins against the serial order; modularity and Potts communities on known graphs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stemma.operators import community, leiden
from stemma.plans import catalogue

from .conftest import DATA


def graph(spark, pairs, alone=()):
    ids = sorted({x for p in pairs for x in p} | set(alone))
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(pairs)], "id string, src string, dst string")


def triangles(n):
    pairs = [(f"t{i:02d}{x}", f"t{i:02d}{y}") for i in range(n) for x, y in ("ab", "bc", "ac")]
    return pairs + [(f"t{i:02d}c", f"t{(i + 1) % n:02d}a") for i in range(n)]


def connected(groups, pairs):
    around = defaultdict(set)
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    for members in groups:
        seen, todo = set(), [next(iter(members))]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += around[x] & members
        assert seen == members


def grouped(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["label"]].add(r["id"])
    return list(out.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_the_serial_order(spark, seed):
    rng = random.Random(seed)
    pairs = [tuple(rng.sample([f"v{i:02d}" for i in range(40)], 2)) for _ in range(60)]
    nodes, edges = graph(spark, pairs, ["lone"])
    want = community.propagate(sorted({x for p in pairs for x in p} | {"lone"}), pairs)
    got = {r["id"]: r["label"] for r in community.label_propagation(nodes, edges, most_edges=5).collect()}  # the large component goes by joins
    assert got == want and len(set(got.values())) > 1


def test_a_path_in_id_order_is_the_longest_dependency(spark):
    pairs = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(15)]
    nodes, edges = graph(spark, pairs)
    got = {r["id"]: r["label"] for r in community.propagate_by_joins(edges.selectExpr("src AS a", "dst AS b"), rounds=3).collect()}
    assert got == community.propagate(sorted({x for p in pairs for x in p}), pairs, rounds=3)


def test_ring_of_triangles(spark):
    pairs = triangles(20)
    nodes, edges = graph(spark, pairs)
    potts = leiden.leiden(nodes, edges, resolution=0.3)
    groups = grouped(potts)
    assert len(groups) == 20 and {len(g) for g in groups} == {3}
    assert leiden.objective(edges, potts, 0.3) == pytest.approx(20 * (3 - 0.9))
    by_modularity = leiden.leiden(nodes, edges)
    merged = grouped(by_modularity)
    assert len(merged) < 20 and leiden.objective(edges, by_modularity) > leiden.objective(edges, potts) > 0.6
    connected(merged, pairs)


def test_cliques_a_star_and_a_lone_vertex(spark):
    clique = lambda name: [(f"{name}{i}", f"{name}{j}") for i in range(5) for j in range(i)]
    pairs = clique("a") + clique("b") + [("a0", "b0")] + [("s", f"leaf{i:02d}") for i in range(12)]
    nodes, edges = graph(spark, pairs, ["lone"])
    groups = sorted(map(sorted, grouped(leiden.leiden(nodes, edges, resolution=0.4))), key=lambda g: (-len(g), g))
    assert groups[:2] == [[f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]] and ["lone"] in groups
    assert Counter(len(g) for g in groups if g[0].startswith("leaf"))[1] > 8  # a star isn't a dense group
    by_modularity = grouped(leiden.leiden(nodes, edges))
    connected(by_modularity, pairs)
    assert {f"a{i}" for i in range(5)} in by_modularity and len(by_modularity) == 4
    with pytest.raises(ValueError):
        leiden.leiden(nodes, edges, resolution=0.0)


def test_no_edges(spark):
    nodes, _ = graph(spark, [], ["x", "y"])
    assert grouped(leiden.leiden(nodes, spark.createDataFrame([], "id string, src string, dst string"))) == [{"x"}, {"y"}]


@pytest.mark.parametrize("row", [3, 50_000])
def test_kinds_of_ids_go_by_stretches(spark, monkeypatch, row):
    """A graph whose edges join kinds takes one step a kind and round; components and joins over all edges took many."""
    rng = random.Random(row)
    pairs = [(f"{a}{rng.randrange(12):02d}", f"{b}{rng.randrange(12):02d}") for a, b in ("ab", "cb", "cd", "bd", "da") for _ in range(14)]
    nodes, edges = graph(spark, pairs, ["a99", "lone"])
    ordered = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    starts = community.stretches(ordered)
    assert 0 < len(starts) <= 3 and not any(a >= s and all(t > b for t in starts if t > s) for s in starts for a, b in [sorted(p) for p in pairs])
    assert community.stretches(ordered, most=1) is None
    monkeypatch.setattr(community, "ROW", row)
    monkeypatch.setattr(community, "connected_components", lambda *_: pytest.fail("no components are needed"))
    for rounds in (1, 2, 20):
        want = community.propagate(sorted({x for p in pairs for x in p} | {"a99", "lone"}), pairs, rounds)
        got = {r["id"]: r["label"] for r in community.label_propagation(nodes, edges, rounds, most_edges=5).collect()}
        assert got == want and len(set(got.values())) > 2


def test_summaries_read_a_stored_graph(spark):
    """Labels, degrees and inner relations each derived the graph anew."""
    found = catalogue.queries()["community_summary"](spark, DATA)
    assert not [f for f in found.inputFiles() if "lineitem" in f] and found.count() >= 1
