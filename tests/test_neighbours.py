"""The inverted file against comparing everything: recall on the given table, work when the input doubles."""

from __future__ import annotations

import numpy as np
import pytest

from stemma.operators import neighbours, search

from .conftest import DATA


def clustered(n: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, 16))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.1, size=(n, 16))


def frame(spark, v: np.ndarray, groups: int = 1):
    return spark.createDataFrame([(i, row.tolist(), i % groups) for i, row in enumerate(v)], "id long, v array<double>, g int")


def found(df):
    return {(r["a"], r["b"]): round(r["cosine"], 9) for r in df.collect()}


@pytest.mark.parametrize("groups", [1, 3])
def test_clustered_vectors(spark, groups):
    df = frame(spark, clustered(900), groups)
    exact, got = found(search.knn_pairs(df, "id", "v", "g", threshold=0.5)), found(neighbours.knn_pairs_indexed(df, "id", "v", "g", threshold=0.5, block=64))
    hit = [p for p in exact if p in got]
    assert len(hit) >= 0.92 * len(exact) > 0 and all(got[p] == exact[p] for p in hit)


def test_recall_on_the_whole_table(spark):
    """The given vectors have no clusters at all: most lists are probed, and the recall is what was asked for."""
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("g", search.F.lit(0))
    exact, got = (found(f(df, "vec_id", "embedding", "g", threshold=-1.0)) for f in (search.knn_pairs, neighbours.knn_pairs_indexed))
    assert sum(p in got for p in exact) >= 0.9 * len(exact)


def test_work_grows_below_the_square(spark):
    work = []
    for n in (1000, 2000, 4000):
        df = frame(spark, clustered(n))
        lists = neighbours.fit_lists(df, "id", "v")
        work.append(neighbours.comparisons(neighbours.candidate_blocks(df, "id", "v", "g", lists, 128)))
        assert work[-1] < n * n / 4
    assert work[1] < 3.4 * work[0] and work[2] < 3.4 * work[1]


def test_written_index(spark, tmp_path):
    v = clustered(1500)
    df, path = frame(spark, v), str(tmp_path / "vectors")
    lists = neighbours.write_vectors(df, "id", "v", path, k=5)
    assert neighbours.read_lists(spark, path).probes == lists.probes < len(lists.centroids) / 2
    assert spark.read.parquet(f"{path}/rows").count() == 1500
    hits = total = 0
    u = neighbours.unit(v)
    for q in range(0, 1500, 150):
        want = set(np.argsort(-(u @ u[q]), kind="stable")[:5].tolist())
        got = neighbours.search_vectors(spark, path, v[q].tolist(), 5, lists).collect()
        assert all(abs(r["score"] - (u[r["key"]] @ u[q] + 1) / 2) < 1e-9 for r in got)
        hits, total = hits + len(want & {r["key"] for r in got}), total + 5
    assert hits >= 0.9 * total


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1)], "id long, v array<double>, g int")
    assert neighbours.knn_pairs_indexed(df, "id", "v", "g").count() == 0
    one = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1)], "id long, v array<double>, g int")
    assert found(neighbours.knn_pairs_indexed(one, "id", "v", "g", threshold=-1.0)) == found(search.knn_pairs(one, "id", "v", "g", threshold=-1.0))


def test_rows_go_to_few_blocks(spark):
    """A query goes to a shelf once, however many of its lists it probes; copies tie by key in whatever block they lie."""
    v = np.random.default_rng(5).normal(size=(1500, 16))
    df = frame(spark, v)
    lists = neighbours.fit_lists(df, "id", "v")
    assert lists.probes > search.SPLITS
    blocks = neighbours.candidate_blocks(df, "id", "v", "g", lists)
    sides = {r["side"]: r["count"] for r in blocks.groupBy("side").count().collect()}
    assert sides[0] <= search.SPLITS * 1500 and sides[1] <= search.SPLITS * 1500
    copies = frame(spark, np.vstack([v[:40]] * 40))
    got = found(search.knn_pairs(copies, "id", "v", "g", k=2, block=100))
    want = {tuple(sorted((i, j))) for i in range(1600) for j in [x for x in range(i % 40, 1600, 40) if x != i][:2]}
    assert set(got) == want
