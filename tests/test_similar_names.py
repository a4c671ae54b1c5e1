"""The bounds of the name ratio lose no pair; communities of the neighbour graph equal the serial order."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from stemma.operators import community, resolve
from stemma.plans import catalogue

from .conftest import DATA


def test_bounds_lose_no_pair(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(45)] + ["", "ü", "C++", "aaaa", "aaab"]
    words += [w + rng.choice("xyz") for w in words[:10]]
    nodes = spark.createDataFrame(list(enumerate(words)), "id long, normalized_name string")
    named = spark.createDataFrame([(i, j, words[i], words[j]) for i, j in combinations(range(len(words)), 2)], "a long, b long, name_a string, name_b string")
    want = {(i, j): SequenceMatcher(None, words[i], words[j]).ratio() for i, j in combinations(range(len(words)), 2)}
    want = {p: r for p, r in want.items() if r >= resolve.NAME_RATIO}
    got = {(r["a"], r["b"]): r["ratio"] for r in resolve.similar_names(named, nodes).collect()}
    assert got == want and want
    assert resolve.within_reach(named, nodes).count() < 0.2 * named.count()


def test_letters_are_numbered(spark):
    df = spark.createDataFrame([("abaa",), ("",)], "t string").select(resolve.numbered_letters(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == [["a1", "b1", "a2", "a3"], []]


def test_name_similarity_of_the_catalogue(spark):
    n = catalogue._known(spark, DATA)
    names = {r["id"]: r["normalized_name"] for r in n.collect()}
    want = {(r["a"], r["b"]): SequenceMatcher(None, names[r["a"]], names[r["b"]]).ratio() for r in resolve.block_pairs(n).collect()}
    got = {(r["a"], r["b"]): r["ratio"] for r in catalogue.queries()["merge_name_similarity"](spark, DATA).collect()}
    assert got == {p: round(r, 6) for p, r in want.items() if r >= resolve.NAME_RATIO} and got


def test_neighbour_communities(spark):
    nodes, edges = catalogue._near_graph(spark, DATA)
    labels = community.propagate(sorted(r["id"] for r in nodes.collect()), [(r["src"], r["dst"]) for r in edges.collect()])
    for name in ("neighbour_communities", "neighbour_communities_joined"):
        got: dict[str, set] = {}
        for r in catalogue.queries()[name](spark, DATA).collect():
            got.setdefault(r["community_id"], set()).add(r["id"])
        want: dict[str, set] = {}
        for i, label in labels.items():
            want.setdefault(label, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(got) > 5


def test_chains_of_many_small_sets_are_walked_in_one_pass(spark):
    """Tasks walk their sets row by row; a call and a frame for each set was three quarters of the time."""
    rng = random.Random(5)
    rows = [(i, rng.choice("TU"), f"n{rng.randrange(60)}", [f"n{rng.randrange(60)}" for _ in range(rng.randrange(3))] if i % 2 else []) for i in range(80)]
    want, exact, alias = {}, {}, {}
    for seq, kind, name, keys in rows:
        owner = exact.get((kind, name), alias.get((kind, name)))
        if owner is None:
            owner = exact[kind, name] = seq
        for k in keys:
            alias.setdefault((kind, k), owner)
        want[seq] = owner
    df = spark.createDataFrame(rows[::-1], "seq long, entity_type string, normalized_name string, alias_keys array<string>")
    found = resolve.resolve_sequentially(df)
    assert "FlatMapGroupsIn" not in found._jdf.queryExecution().toString()
    assert {r["seq"]: r["node_key"] for r in found.collect()} == want


def test_containment_compares_names_and_not_their_bearers(spark):
    """The pairs of all bearers are those of ``block_pairs``; names with many bearers are compared once."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=rng.randint(3, 7))) for _ in range(30)]
    words += [w + "xy" for w in words[:12]] + ["", "abc"]
    rows = [(f"{i}", rng.choice("TU"), w) for i, w in enumerate(words * 3)] + [(f"m{i}", "T", words[0]) for i in range(40)] + [(f"q{i}", "U", words[3] + "xy") for i in range(70)]
    nodes = spark.createDataFrame(rows, "id string, entity_type string, normalized_name string")
    for most in (4, 64):
        pairs = resolve.block_pairs(nodes, max_block=most)
        want = {(r["a"], r["b"]) for r in resolve.containment(resolve.pair_names(pairs, nodes)).collect()}
        got = [(r["a"], r["b"]) for r in resolve.contained_names(nodes, most).collect()]
        assert set(got) == want and len(got) == len(want) and (most == 4 or want)


def test_very_common_keys_stay_where_they_are(spark, monkeypatch):
    """Keys beyond ``HOT`` open the same pairs without going through one task; two names are rated once for all their bearers."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(25)]
    rows = [(f"{i}", rng.choice("TU"), w) for i, w in enumerate(words * 4)]
    nodes = spark.createDataFrame(rows, "id string, entity_type string, normalized_name string")
    want = {(r["a"], r["b"]) for r in resolve.block_pairs(nodes, max_block=3).collect()}
    monkeypatch.setattr(resolve, "HOT", 3)
    got = resolve.block_pairs(nodes, max_block=3)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and want
    named = resolve.pair_names(got, nodes)
    names = {i: w for i, _, w in rows}
    ratios = {p: SequenceMatcher(None, names[p[0]], names[p[1]]).ratio() for p in want}
    seen = []
    bounds = resolve.within_reach
    monkeypatch.setattr(resolve, "within_reach", lambda pairs, *more: seen.append(pairs) or bounds(pairs, *more))
    assert {(r["a"], r["b"]): r["ratio"] for r in resolve.similar_names(named, nodes).collect()} == {p: r for p, r in ratios.items() if r >= resolve.NAME_RATIO}
    assert seen[0].count() == len({(names[a], names[b]) for a, b in want if names[a] != names[b]})
