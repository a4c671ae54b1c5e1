"""Quality rules: fixed document statistics, then gradient-boosted trees scored from flat arrays.

The trees are fitted here (logistic loss, histogram splits) on a bounded sample of labelled rows
and flattened into node arrays (feature, threshold, left, right, value); scoring walks all
documents of a batch down all trees at once by array indexing. ``MONOTONE`` features may only
lower a score: a split that would break the order is refused, and a split's midpoint bounds both
sides below it, so the constraint holds for whole trees and so for their sum.

Defined cases: null and empty texts have all statistics zero and fail the base rule; texts of any
length are counted whole; when the labels don't hold both classes no trees are grown and the base
rule alone decides; rows of ``labels`` with null or other values are left out; equal gains go to
the first feature and the lowest cut; rows that repeat, or whose doc_id repeats or is null, are
scored alike and a repeated doc_id is learned from once; an empty table gives no rows. Extra
columns of any name are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, alone, hashed_sample

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 5
FEATURES = ["log_words", "mean_word", "symbols_per_word", "dup_lines", "repeats", "upper", "digits", "bangs", "bars", "line_words", "distinct", "stops"]
#: Features of which more never makes a document better.
MONOTONE = {"symbols_per_word": -1, "dup_lines": -1, "repeats": -1, "bangs": -1, "bars": -1}
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside ``size``-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words), bool)
    for k in range(size):
        cover[k : k + len(twice)] |= twice
    return int(cover.sum())


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(SPACES))


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), model features."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup, rep = duplicate_lines(text), repeated_words(words)
    lines, d, c = text.count("\n") + 1, max(n, 1), max(chars, 1)
    upper, digits = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _DIGITS))
    features = [np.log1p(n), chars / d, symbols / d, dup / lines, rep / d, upper / c, digits / c, text.count("!") / d, text.count("|") / d, np.log1p(n / lines), len(set(words)) / d, (text.count(".") + text.count(",")) / d]
    return (n, chars, symbols, dup, rep), features


@dataclass
class FlatTrees:
    """Complete trees laid end to end; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, monotone: dict[int, int] | None = None) -> FlatTrees:
    """Newton boosting of the logistic loss on binned features."""
    weight = np.ones(len(y)) if weight is None else weight
    monotone = monotone or {}
    both = len(y) and 0 < (weight * y).sum() < weight.sum()
    p = (weight * y).sum() / weight.sum() if both else 0.5
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if both else np.zeros(0) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    nodes: list[list[float]] = []
    roots: list[int] = []
    margin = np.full(len(y), base)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + l2), low, high))
        nodes.append([0, np.inf, me, me, value * rate])
        best = (1e-6, -1, 0, 0.0)
        if level < depth and len(rows) >= 20:
            g_all, h_all = grad[rows].sum(), hess[rows].sum()
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                g = np.bincount(binned[f][rows], grad[rows], len(c) + 1).cumsum()[:-1]
                h = np.bincount(binned[f][rows], hess[rows], len(c) + 1).cumsum()[:-1]
                gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
                gain[(h < 1) | (h_all - h < 1)] = -1
                if f in monotone:
                    left, right = np.clip(-g / (h + l2), low, high), np.clip(-(g_all - g) / (h_all - h + l2), low, high)
                    gain[(right - left) * monotone[f] < 0] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, 0.0)
        if best[1] < 0:
            leaves.append((rows, value * rate))
            return me
        _, f, k, _ = best
        goes_left = binned[f][rows] <= k
        bounds = [(low, high), (low, high)]
        if f in monotone:
            a, b = (np.clip(-grad[r].sum() / (hess[r].sum() + l2), low, high) for r in (rows[goes_left], rows[~goes_left]))
            mid = float(a + b) / 2
            bounds = [(low, mid), (mid, high)] if monotone[f] > 0 else [(mid, high), (low, mid)]
        left = grow(rows[goes_left], level + 1, *bounds[0])
        right = grow(rows[~goes_left], level + 1, *bounds[1])
        nodes[me][:4] = [f, cuts[f][k], left, right]
        return me

    for _ in range(trees if both else 0):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (prob - y), weight * prob * (1 - prob)
        leaves: list[tuple[np.ndarray, float]] = []
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        for rows, value in leaves:
            margin[rows] += value
    table = np.array(nodes, float).reshape(-1, 5)
    ints = [table[:, k].astype(np.int64) for k in (0, 2, 3)]
    return FlatTrees(ints[0], table[:, 1], ints[1], ints[2], table[:, 4], np.array(roots, np.int64), base, depth)


def _features_of(docs: DataFrame, extra: list[str]) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra), "x array<double>"])
    out = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t)[1] for t in batch.column(len(extra)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], pa.array(x, out.field(len(extra)).type)], schema=out)

    return docs.select(*extra, "text").mapInArrow(alone(run), schema)


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """One row (doc_id, y) a labelled document; documents with contrary labels are left out."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("top")).where("y = top").select("doc_id", "y")


def balanced_sample(ids: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` ids of each class by key hash, and the sizes of the whole classes."""
    totals = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [hashed_sample(ids.where(F.col("y") == y), "doc_id", per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), totals


def fit_quality_trees(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000) -> FlatTrees:
    """``per_class`` bounds the labelled rows of each class that are fitted on (the documented sample)."""
    chosen, totals = balanced_sample(labelled_ids(labels, label), per_class)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids
    found = _features_of(sample, ["doc_id", "y"]).groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    rows = sorted((r["doc_id"], r["y"], r["x"]) for r in found.collect())
    x = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r[1] for r in rows], float)
    weight = np.where(y == 1, totals.get(1, 0) / max((y == 1).sum(), 1), totals.get(0, 0) / max((y == 0).sum(), 1))
    weight = weight * len(y) / max(weight.sum(), 1e-9)
    return fit_trees(x, y, weight, monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})


def score_quality(docs: DataFrame, trees: FlatTrees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, score."""
    spark = docs.sparkSession
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    out = _arrow_schema(spark, schema)
    shared = spark.sparkContext.broadcast(trees)  # trees * 2^depth nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            base = np.array([b for b, _ in found], np.int64).reshape(-1, 5)
            score = shared.value.score(np.array([x for _, x in found], float).reshape(-1, len(FEATURES)))
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            columns = [batch.column(0).cast(pa.int64()), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.select("doc_id", "text").mapInArrow(alone(run), schema)


def op1_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, fit_quality_trees(docs, labels))
