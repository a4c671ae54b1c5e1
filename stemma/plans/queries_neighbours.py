"""Queries over the inverted file of the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours, search
from . import testbed as tb
from .catalogue import query


@query("vector_knn_indexed")
def _(s, d):
    pairs = neighbours.knn_pairs_indexed(tb.table(s, d, "embeddings"), "vec_id", "embedding", "label", threshold=0.2)
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("vector_index_recall")
def _(s, d):
    """Of each label's exact pairs, how many the inverted file finds."""
    rows = tb.table(s, d, "embeddings")
    exact = search.knn_pairs(rows, "vec_id", "embedding", "label", threshold=0.2)
    got = neighbours.knn_pairs_indexed(rows, "vec_id", "embedding", "label", threshold=0.2).select("a", "b", F.lit(1).alias("found"))
    label = rows.select(F.col("vec_id").alias("a"), "label")
    both = exact.join(got, ["a", "b"], "left").join(label, "a")
    return both.groupBy("label").agg(F.count("*").alias("pairs"), F.count("found").alias("found"), F.round(F.count("found") / F.count("*"), 4).alias("recall"))
