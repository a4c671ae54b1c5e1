"""Names that many bear and parts of names that many share lose no pair."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, Decimal
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stemma.operators import likeness, resolve
from stemma.plans import catalogue

KEYS = {"region": "r_regionkey r_name", "nation": "n_nationkey n_name", "supplier": "s_suppkey s_name", "part": "p_partkey p_name", "customer": "c_custkey c_name"}


@pytest.fixture
def crowded(tmp_path):
    """Parts and customers of which far more than 64 share a name or parts of one; and vectors of which more than five are alike."""
    rng = random.Random(6)
    names = {
        "region": ["EUROPE", "ASIA"],
        "nation": [f"NATION_{i}" for i in range(12)],
        "supplier": [f"Supplier#{i:09d}" for i in range(75)],
        "part": ["red rod"] * 90 + ["red rods"] * 3 + ["old rod"] * 4 + [f"{c} anvil" for c in ("dark red", "red", "dark")],
        "customer": [f"Customer#{rng.randrange(3000):09d}" for _ in range(110)],
    }
    for table, columns in KEYS.items():
        key, name = columns.split()
        pq.write_table(pa.table({key: pa.array(range(1, len(names[table]) + 1), pa.int64()), name: names[table]}), tmp_path / f"{table}.parquet")
    base = np.random.default_rng(2).normal(size=(3, 8))
    vectors = [base[i % 3] + np.random.default_rng(i).normal(size=8) / 20 for i in range(60)]
    pq.write_table(pa.table({"vec_id": pa.array(range(60), pa.int64()), "embedding": pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))}), tmp_path / "embeddings.parquet")
    return str(tmp_path), vectors


def ratio(a: str, b: str) -> float | None:
    r = SequenceMatcher(None, a, b).ratio()
    return r if r >= resolve.NAME_RATIO and a and b else None


def by_type(nodes):
    rows = sorted((r["id"], r["entity_type"], r["normalized_name"]) for r in nodes.collect())
    return [(a, b) for a, b in combinations(rows, 2) if a[1] == b[1]]


def test_names_that_many_bear_lose_no_similar_pair(spark, crowded):
    n = catalogue._known(spark, crowded[0])
    want = {(a[0], b[0]): round(r, 6) for a, b in by_type(n) if (r := ratio(a[2], b[2])) is not None}
    rows = catalogue.queries()["merge_name_similarity"](spark, crowded[0]).collect()
    got = {(r["a"], r["b"]): r["ratio"] for r in rows}
    assert got == want and len(rows) == len(got) > 5000


def test_candidates_have_every_pair_that_a_signal_speaks_for(spark, crowded):
    folder, vectors = crowded
    unit = {("P" if i % 2 == 0 else "C") + str(i // 2 + 1): v / np.linalg.norm(v) for i, v in enumerate(vectors)}
    want, near_pairs = {}, 0
    for (a, kind, x), (b, _, y) in by_type(catalogue._known(spark, folder)):
        keys = [{n, n[4:]} if kind == "Part" else {n} for n in (x, y)]
        short, long = sorted((x, y), key=len)
        cos = round(float(unit[a] @ unit[b]), 12) if a in unit and b in unit else 0.0
        says = {
            "name similarity": ratio(x, y),
            "containment": 0.85 if x != y and len(short) >= 4 and short in long else None,
            "shared alias": 0.95 if (keys[0] & keys[1]) - {""} else None,
            "embedding cosine": cos if cos >= resolve.COSINE else None,
        }
        known = {k: v for k, v in says.items() if v is not None}
        near_pairs += "embedding cosine" in known
        if known:
            want[a, b] = (round(max(known.values()), 6), "; ".join(f"{k} {Decimal(v).quantize(Decimal('0.01'), ROUND_HALF_EVEN)}" for k, v in known.items()))
    rows = catalogue.queries()["merge_candidates"](spark, folder).collect()
    got = {(r["a"], r["b"]): (r["score"], r["reasons"]) for r in rows}
    assert got == want and len(rows) == len(got) and near_pairs > 200


def names_of(rng: random.Random) -> list[str]:
    letters = rng.choice(["ab", "0123456789", "abé漢😀"])
    start = "".join(rng.choices(letters, k=rng.randint(0, 14)))
    return [(start if rng.random() < 0.8 else "") + "".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(40)] + ["", "x" * 205 + "ab", "x" * 204 + "ba"]


def test_ratios_are_those_of_difflib_in_many_blocks(spark, monkeypatch):
    """Ends rated by pattern, long names, letters beyond ASCII, either order of a pair; blocks of a few nodes each."""
    monkeypatch.setattr(likeness, "SHARED", 12)
    rng = random.Random(9)
    rows = [(f"{kind}{i}", kind, name) for kind in "TUVW" for i, name in enumerate(names_of(rng))] + [("n1", "T", None), ("n2", "T", None), ("o1", None, "ab"), ("o2", None, "ab")]
    nodes = spark.createDataFrame(rows, "id string, entity_type string, normalized_name string")
    for threshold in (0.5, resolve.NAME_RATIO):
        want = {(a, b): r for (a, s, x), (b, t, y) in combinations(sorted(r for r in rows if r[1] and r[2]), 2) if s == t and (r := SequenceMatcher(None, x, y).ratio()) >= threshold}
        got = likeness.signal_pairs(nodes, threshold).collect()
        assert {(r["a"], r["b"]): r["alike"] for r in got} == want and len(got) == len(want) > 100


def test_empty_names_and_empty_keys_say_nothing(spark):
    rows = [("1", "T", "", ["k"]), ("2", "T", "", ["k", ""]), ("3", "T", "", [""]), ("4", "T", "zebra", [""]), ("5", "T", None, ["k"])]
    nodes = spark.createDataFrame(rows, "id string, entity_type string, normalized_name string, keys array<string>")
    got = {(r["a"], r["b"]): (r["alike"], r["alias"]) for r in likeness.signal_pairs(nodes, 0.8, 4, "keys").collect()}
    assert got == {("1", "2"): (1.0, True), ("1", "5"): (None, True), ("2", "5"): (None, True)}
