"""Nearest neighbours by an inverted file: rows are dealt to lists by their nearest centroid, queries look into a few lists.

Centroids come from spherical k-means on a bounded sample by key hash (``SAMPLE_ROWS``); there are
about as many lists as the square root of the rows, ``MOST_LISTS`` at most, which bounds what is
broadcast. Every row is in exactly one list. How many lists a query probes is measured: on the
sample, the share of true neighbours found with the p nearest lists is known exactly, and the
smallest p that reaches the wanted recall is taken. Neighbours in the whole table are nearer than in
the sample, so the sample's figure errs on the careful side. Clustered vectors need few lists;
vectors without any structure need most of them, and then the work isn't much below comparing all.

Candidates are compared on their full vectors, so cosines are exact and only a neighbour in a list
that wasn't probed can be missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from .search import SPLITS, Nearest, cosine, in_pieces, mutual_pairs, number_keys, spread, unit_rows

SAMPLE_ROWS, SAMPLE_QUERIES, MOST_LISTS, ROUNDS = 20_000, 500, 16_384, 10


@dataclass
class Lists:
    """Unit centroids, and how many lists a query probes."""

    centroids: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first; ties to the lower number."""
        return np.argsort(-(unit(vectors) @ self.centroids.T), axis=1, kind="stable")[:, :n]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def fit_lists(rows: DataFrame, key: str, vector: str, k: int = 5, recall: float = 0.95, lists: int | None = None, group: str | None = None) -> Lists | None:
    """Lists for all rows with a vector (probes for neighbours within ``group``); None where there are none."""
    known = rows.where(F.col(vector).isNotNull())
    n = known.count()
    if not n:
        return None
    sample = known.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select(vector, F.col(group) if group else F.lit(0)).collect()
    x = unit(np.array([r[0] for r in sample], float))
    count = max(1, min(lists or round(n**0.5), MOST_LISTS, len(x)))
    c = x[:count].copy()
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        filled = np.linalg.norm(sums, axis=1) > 1e-12
        c[filled] = unit(sums[filled])
    found = Lists(c, count)
    found.probes = _probes(found, x, np.unique([str(r[1]) for r in sample], return_inverse=True)[1], k, recall)
    return found


def _probes(found: Lists, x: np.ndarray, groups: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists with which the sample's queries find ``recall`` of their k nearest."""
    q = x[:SAMPLE_QUERIES]
    cos = q @ x.T
    cos[groups[: len(q), None] != groups[None, :]] = -np.inf
    cos[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-cos, axis=1, kind="stable")[:, :k]
    true = np.isfinite(np.take_along_axis(cos, near, 1))
    if not true.any():
        return len(found.centroids)
    order = found.nearest(q, len(found.centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(q), 0), 1)
    home = found.nearest(x, 1)[:, 0]
    ranks = np.sort(np.take_along_axis(place, home[near], 1)[true])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def shelves(found: Lists) -> int:
    """Lists lie on shelves by their number; a query goes to a shelf once, however many of its lists it probes."""
    return min(SPLITS, len(found.centroids))


def deal(rows: DataFrame, vector: str, found: Lists) -> DataFrame:
    """``rows`` with ``list``, their own one, and ``probed``: for each shelf the probed lists as bits, null where there are none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("list", IntegerType()), StructField("probed", ArrayType(BinaryType()))])
    out = to_arrow_schema(schema)
    at, n = rows.columns.index(vector), shelves(found)
    held = rows.sparkSession.sparkContext.broadcast(found)  # MOST_LISTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            column = batch.column(at)
            v = np.asarray(column.flatten(), float).reshape(len(column), -1)
            near = held.value.nearest(v, held.value.probes).astype(np.int32)
            asks = np.zeros((len(near), len(held.value.centroids)), bool)
            np.put_along_axis(asks, near, True, 1)
            bits = [np.packbits(asks[:, s::n], axis=1) for s in range(n)]
            probed = [[b[i].tobytes() if b[i].any() else None for b in bits] for i in range(len(near))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0]), pa.array(probed, out.field("probed").type)], schema=out)

    return rows.mapInArrow(run, schema)


def candidate_blocks(rows: DataFrame, key: str, vector: str, group: str, found: Lists, block: int = 65_536) -> DataFrame:
    """Both sides of every comparison: (g, shelf, i, j, key, v, slot, bits, side); a task holds ``block`` members and about as many queries of a shelf."""
    dealt = cut(deal(rows.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(vector).alias("v")), "v", found))  # read four times
    n = F.lit(shelves(found))
    members = dealt.select("g", "key", "v", F.floor(F.col("list") / n).cast("int").alias("slot"), F.pmod("list", n).alias("shelf"))
    asked = dealt.select("g", "key", "v", F.posexplode("probed").alias("shelf", "bits")).where("bits IS NOT NULL")
    size = members.groupBy("g", "shelf").agg(F.ceil(F.count("*") / block).cast("int").alias("js")).join(asked.groupBy("g", "shelf").agg(in_pieces(F.count("*"), block).alias("is")), ["g", "shelf"])
    number = lambda count: F.pmod(F.xxhash64("key"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    left = asked.join(size, ["g", "shelf"]).withColumn("i", number("is")).select("g", "shelf", "i", every("js").alias("j"), "key", "v", none("int").alias("slot"), "bits", F.lit(0).alias("side"))
    right = members.join(size, ["g", "shelf"]).withColumn("j", number("js")).select("g", "shelf", every("is").alias("i"), "j", "key", "v", "slot", none("binary").alias("bits"), F.lit(1).alias("side"))
    return left.unionByName(right)


def by_list(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, list[tuple[np.ndarray, np.ndarray]]]:
    """A block's queries and members, each by key, and for each of its lists the places of those that meet there."""
    asked, members = (pdf[pdf["side"] == s].sort_values("key") for s in (0, 1))
    if asked.empty or members.empty:
        return asked, members, []
    bits = np.unpackbits(np.frombuffer(b"".join(asked["bits"]), np.uint8).reshape(len(asked), -1), axis=1)
    own = members["slot"].to_numpy().astype(int)
    order = np.argsort(own, kind="stable")
    meets = np.split(order, np.flatnonzero(np.diff(own[order])) + 1)
    return asked, members, [(np.flatnonzero(bits[:, own[m[0]]]), m) for m in meets]


def comparisons(blocks: DataFrame) -> int:
    """How many pairs of rows are compared."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [sum(len(a) * len(b) for a, b in by_list(pdf)[2])]})

    return blocks.groupBy("g", "shelf", "i", "j").applyInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def nearest_in_lists(k: int, threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The k nearest of a block's members for each of its queries, among the lists that it probes."""

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, members, meets = by_list(pdf)
        keys, others = asked["key"].to_numpy(), members["key"].to_numpy()
        best = Nearest(len(keys), k, threshold)
        if meets:
            x, y, codes = unit_rows(asked["v"]), unit_rows(members["v"]), number_keys(keys, others)
            for rows, places in meets:
                best.meet(x, rows, y, places, codes)
        return best.frame(keys, others)

    return near


def knn_pairs_indexed(rows: DataFrame, key: str, vector: str, group: str, k: int = 5, threshold: float = 0.9, recall: float = 0.95, block: int = 65_536) -> DataFrame:
    """``search.knn_pairs`` by lists: a, b, cosine."""
    kind = dict(rows.dtypes)[key]
    found = fit_lists(rows, key, vector, k, recall, group=group)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cosine double")
    near = spread(candidate_blocks(rows, key, vector, group, found, block), "g", "shelf", "i", "j").groupBy("g", "shelf", "i", "j").applyInPandas(nearest_in_lists(k, threshold), f"key {kind}, other {kind}, cos double")
    return mutual_pairs(near, k, threshold)


def write_vectors(rows: DataFrame, key: str, vector: str, path: str, k: int = 10, recall: float = 0.95) -> Lists | None:
    """The index: every row under its list, files in the order of lists; and the centroids."""
    found = fit_lists(rows, key, vector, k, recall)
    if found is None:
        return None
    dealt = deal(rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v")), "v", found)
    dealt.select("key", "v", "list").repartitionByRange("list").sortWithinPartitions("list").write.parquet(f"{path}/rows")
    spark = rows.sparkSession
    spark.createDataFrame([(i, c.tolist(), found.probes) for i, c in enumerate(found.centroids)], "list int, centroid array<double>, probes int").write.parquet(f"{path}/lists")
    return found


def read_lists(spark: SparkSession, path: str) -> Lists:
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # MOST_LISTS rows at most
    return Lists(np.array([r["centroid"] for r in rows]), rows[0]["probes"])


def search_vectors(spark: SparkSession, path: str, query: list[float], k: int = 10, found: Lists | None = None) -> DataFrame:
    """key, score = (cosine + 1) / 2 of the k best rows in the query's lists; only these lists are read."""
    found = found or read_lists(spark, path)
    lists = found.nearest(np.array([query], float), found.probes)[0].tolist()
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = spark.read.parquet(f"{path}/rows").where(F.col("list").isin(lists))
    return rows.select("key", ((cosine(F.col("v"), q) + 1) / 2).alias("score")).orderBy(F.desc("score"), "key").limit(k)
