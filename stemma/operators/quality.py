"""Calibration, conformal triage and extraction evaluation."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut


def ece_bins(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, claimed, observed of (confidence, label); equal-width bins, 1.0 in the last."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return pairs.where("confidence IS NOT NULL").select(b, "confidence", "label").groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("claimed"), F.avg(F.col("label").cast("double")).alias("observed"))


def ece(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """One row: the expected calibration error; null without pairs."""
    t = ece_bins(pairs, bins)
    return t.agg(F.round(F.sum(F.col("n") * F.abs(F.col("claimed") - F.col("observed"))) / F.sum("n"), 4).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def pool_adjacent(points: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """The isotonic fit to (x, weight, sum) in x order, as pooled points of the same form, their means rising.

    The fit is the slope of the greatest convex minorant of the running sums, so a vertex stays
    only while the slope turns up at it.
    """
    xs, corners, weight, total = [], [(0.0, 0.0)], 0.0, 0.0
    for x, w, s in points:
        weight, total = weight + w, total + s
        xs.append(x)
        while len(corners) > 1:
            (w0, s0), (w1, s1) = corners[-2:]
            if (s1 - s0) * (weight - w1) < (total - s1) * (w1 - w0):
                break
            corners.pop()
            xs.pop()
        corners.append((weight, total))
    return [(x, w1 - w0, s1 - s0) for x, (w0, s0), (w1, s1) in zip(xs, corners, corners[1:])]


def isotonic_steps(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(left boundary, value) of the fit."""
    return [(x, s / w) for x, w, s in pool_adjacent(points)]


def isotonic_curve(pairs: DataFrame, partitions: int = 32) -> DataFrame:
    """boundary, value: a step function.

    Spark pools ties; each range of confidences is then fitted where it lies, and the last task
    fits the pooled points of the ranges alone. Points pooled within a range are pooled in the
    whole fit too, so the result is that of one fit over all.
    """
    tied = pairs.where("confidence IS NOT NULL").groupBy("confidence").agg(F.count("*").cast("double").alias("w"), F.sum(F.col("label").cast("double")).alias("s"))
    ranges = tied.repartitionByRange(partitions, "confidence").sortWithinPartitions("confidence")

    def pool(batches):
        held = pd.concat([pd.DataFrame(columns=["confidence", "w", "s"], dtype=float), *batches])
        yield pd.DataFrame(pool_adjacent(list(held.itertuples(index=False, name=None))), columns=["x", "w", "s"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(isotonic_steps(list(pdf.sort_values("x")[["x", "w", "s"]].itertuples(index=False, name=None))), columns=["boundary", "value"])

    pooled = ranges.mapInPandas(pool, "x double, w double, s double")
    return pooled.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "boundary double, value double")


def isotonic_predict(rows: DataFrame, curve: DataFrame, x: str = "confidence", partitions: int = 64) -> DataFrame:
    """``rows`` with ``calibrated``: the value of the step at or below x, else of the first; null without x or steps.

    Distinct values of x and the steps' boundaries are dealt to ranges together. Values rise along a
    fitted curve, so the step at or below x has the largest value among those of its range up to it
    and those of all ranges before, one number a range.
    """
    asked = rows.select(F.col(x).cast("double").alias("_at")).where("_at IS NOT NULL").distinct()
    steps = curve.select(F.col("boundary").alias("_at"), "value")
    both = steps.unionByName(asked.withColumn("value", F.lit(None).cast("double")))
    dealt = cut(both.repartitionByRange(partitions, "_at").withColumn("_part", F.spark_partition_id()))
    inner = F.max("value").over(Window.partitionBy("_part").orderBy("_at"))  # ties included
    earlier = F.max("top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = dealt.groupBy("_part").agg(F.max("value").alias("top")).select("_part", earlier.alias("_before"))  # a row a range
    first = dealt.agg(F.min("value").alias("_first"))  # one row
    found = dealt.withColumn("_inner", inner).where("value IS NULL").join(F.broadcast(before), "_part").crossJoin(F.broadcast(first))
    values = found.select("_at", F.coalesce(F.greatest("_inner", "_before"), "_first").alias("_value"))
    return rows.join(values, F.col(x).cast("double") == F.col("_at"), "left").withColumn("calibrated", F.col("_value")).drop("_at", "_value")


def conformal_rank(n: int, alpha: float) -> int | None:
    """k of the k-th smallest score; None where the sample is too small."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    k = math.ceil((n + 1) * (1 - alpha))
    return k if n and k <= n else None


def conformal_threshold(scores: DataFrame, alpha: float, by: list[str] | None = None, bins: int = 1024) -> DataFrame:
    """n and the conformal quantile of ``score`` (null where it is out of reach), for each group of ``by``.

    Counts in ``bins`` ranges of the unit interval find the range that holds the rank (scores outside it
    fall to the outer ranges), and only that range's distinct scores are ranked.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    by = by or []
    known = scores.where("score IS NOT NULL").select(*by, "score", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("score") * bins))).cast("int").alias("bin"))
    counts = known.groupBy(*by, "bin").agg(F.count("*").alias("c"))
    groups = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("bars"))  # at most ``bins`` a group
    k = F.ceil((F.col("n") + 1) * F.lit(1 - alpha))
    steps = F.aggregate("bars", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("before")), lambda s, x: F.when((s["bin"] < 0) & (s["upto"] + x["c"] >= F.col("k")), F.struct((s["upto"] + x["c"]).alias("upto"), x["bin"].alias("bin"), s["upto"].alias("before"))).otherwise(F.struct((s["upto"] + x["c"]).alias("upto"), s["bin"].alias("bin"), s["before"].alias("before"))))
    if not by:  # without any score there is still one answer
        groups = groups.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("bars", F.array().cast("array<struct<bin:int,c:bigint>>")).alias("bars"))
    wanted = groups.withColumn("k", k).withColumn("at", steps).select(*by, "n", (F.col("k") - F.col("at.before")).alias("left"), F.col("at.bin").alias("bin"))
    tied = known.join(F.broadcast(wanted.select(*by, "bin")), [*by, "bin"], "left_semi").groupBy(*by, "score").agg(F.count("*").alias("c"))  # a row a group
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = tied.withColumn("upto", upto)
    joined = wanted.join(ranked, by, "left") if by else wanted.crossJoin(ranked.groupBy().agg(F.collect_list(F.struct("score", "upto")).alias("r"))).select("n", "left", F.explode_outer("r").alias("r")).select("n", "left", "r.*")
    return joined.groupBy(*by, "n").agg(F.min(F.when(F.col("upto") >= F.col("left"), F.col("score"))).alias("threshold"))


STREAM = ["engine", "model", "prompt_version"]


def calibration_scores(nodes: DataFrame, edges: DataFrame | None, reviews: DataFrame) -> DataFrame:
    """kind, engine, model, prompt_version, score, status of reviewed items that people decided.

    Each kind's stream is that of its latest review: engine, model (null is a model of its own) and
    prompt. An item's score is its latest in that stream.
    """
    latest = reviews.groupBy("kind").agg(F.max_by(F.struct(*STREAM), F.struct("created_ts", "seq")).alias("s")).select(F.col("kind").alias("_kind"), *[F.col(f"s.{c}").alias(f"_{c}") for c in STREAM])
    same = F.col("kind") == F.col("_kind")
    for c in STREAM:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    mine = reviews.join(F.broadcast(latest), same).groupBy("kind", "item_id", *STREAM).agg(F.max_by("score", F.struct("created_ts", "seq")).alias("score"))  # a row a kind
    decided = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), "status")
    if edges is not None:
        decided = decided.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("id").alias("item_id"), "status"))
    return mine.join(decided.where(F.col("status").isin("verified", "rejected")), ["kind", "item_id"])


def conformal_triage(nodes: DataFrame, reviews: DataFrame, alpha: float = 0.05, edges: DataFrame | None = None) -> DataFrame:
    """For each kind's current stream: counts, threshold, needed sample."""
    scored = calibration_scores(nodes, edges, reviews)
    counts = scored.groupBy("kind", *STREAM).agg(F.count_if(F.col("status") == "rejected").alias("n_rejected"), F.count_if(F.col("status") == "verified").alias("n_verified"))
    line = conformal_threshold(scored.where("status = 'rejected'").select("kind", "score"), alpha, ["kind"]).select("kind", "threshold")
    return counts.join(line, "kind", "left").withColumn("needed", F.lit(math.ceil((1 - alpha) / alpha)).cast("long"))


def triage(nodes: DataFrame, edges: DataFrame, reviews: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row for the store, nodes and edges pooled: available, alpha, threshold, n_rejected, n_verified, needed."""
    scored = calibration_scores(nodes, edges, reviews)
    counts = scored.agg(F.count_if(F.col("status") == "rejected").alias("n_rejected"), F.count_if(F.col("status") == "verified").alias("n_verified"))
    line = conformal_threshold(scored.where("status = 'rejected'"), alpha).select("threshold")
    return counts.crossJoin(F.broadcast(line)).select(F.col("threshold").isNotNull().alias("available"), F.lit(alpha).alias("alpha"), "threshold", "n_rejected", "n_verified", F.lit(math.ceil((1 - alpha) / alpha)).cast("long").alias("needed"))  # one row


LEAST_OUTCOMES = 20


def review_outcomes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(confidence, label) of decided items with a confidence; nodes and edges pool."""
    both = nodes.select("status", "confidence").unionByName(edges.select("status", "confidence"))
    return both.where(F.col("status").isin("verified", "rejected") & F.col("confidence").isNotNull()).select("confidence", (F.col("status") == "verified").cast("int").alias("label"))


def calibration_report(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: n, min_required, available, ece; the isotonic curve, empty where outcomes are too few)."""
    pairs = review_outcomes(nodes, edges)
    report = ece(pairs).select("n", F.lit(LEAST_OUTCOMES).cast("long").alias("min_required"), (F.col("n") >= LEAST_OUTCOMES).alias("available"), "ece")
    return report, isotonic_curve(pairs).join(F.broadcast(report.where("available").select("available")), how="left_semi")


def precision_recall(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two sets; both empty gives 1, one empty 0."""
    g, f = gold.select(*keys).distinct().withColumn("g", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    c = g.join(f, keys, "full_outer").agg(*[F.count_if(x).alias(n) for n, x in (("tp", F.col("g").isNotNull() & F.col("f").isNotNull()), ("fp", F.col("g").isNull()), ("fn", F.col("f").isNull()))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    empty = (tp + fp + fn) == 0
    part = lambda other: F.when(empty, 1.0).when(tp + other == 0, 0.0).otherwise(tp / (tp + other))
    return c.select("tp", "fp", "fn", part(fp).alias("precision"), part(fn).alias("recall"), F.when(empty, 1.0).otherwise(2 * tp / (2 * tp + fp + fn)).alias("f1"))


def missing(gold: DataFrame, found: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """The first ``limit`` gold rows that weren't found."""
    return gold.select(*keys).distinct().join(found.select(*keys), keys, "left_anti").orderBy(*keys).limit(limit)


def evaluate(gold: DataFrame, found: DataFrame, keys: list[str], limit: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores with the F1 interval, the first missing rows, the first spurious ones)."""
    counts = precision_recall(gold, found, keys)
    scores = counts.join(bootstrap_interval(counts), ["tp", "fp", "fn"])
    return scores, missing(gold, found, keys, limit), missing(found, gold, keys, limit)


def bootstrap_f1(tp: int, fp: int, fn: int, draws: int = 2000, seed: int = 7) -> tuple[float, float]:
    """Percentile interval (95 %) of F1 over resampled outcomes, to four places.

    The draws are those of ``random.Random(seed).randrange(total)`` one after the other: numpy's
    generator takes over its state, and values of ``total`` or more are drawn again.
    """
    total = tp + fp + fn
    if not total:
        return 1.0, 1.0
    if total >= 2**32:
        raise ValueError("more outcomes than a 32-bit draw can tell apart")
    state = random.Random(seed).getstate()[1]
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    shift = np.uint64(32 - total.bit_length())
    hits, misses = np.zeros(draws, np.int64), np.zeros(draws, np.int64)
    done, wanted = 0, draws * total
    while done < wanted:
        drawn = source.random_raw(min(wanted - done + 1024, 1 << 22)) >> shift
        drawn = drawn[drawn < total][: wanted - done]
        sample = (done + np.arange(len(drawn))) // total
        hits += np.bincount(sample[drawn < tp], minlength=draws)
        misses += np.bincount(sample[drawn >= tp], minlength=draws)
        done += len(drawn)
    return interval_of(hits, misses)


def interval_of(hits: np.ndarray, misses: np.ndarray) -> tuple[float, float]:
    """The percentile interval (95 %) of the samples' F1, to four places."""
    draws = len(hits)
    f1 = np.sort(2 * hits / (2 * hits + misses))
    low, high = int((1 - 0.95) / 2 * draws), min(draws - 1, int((1 - (1 - 0.95) / 2) * draws) - 1)
    return round(float(f1[low]), 4), round(float(f1[high]), 4)


#: Draws up to which a bootstrap is one task; a larger one takes a task for each stretch of the stream.
SERIAL_DRAWS = 1 << 26


def bootstrap_interval(counts: DataFrame) -> DataFrame:
    """low and high for each row of (tp, fp, fn), a row an evaluation; the resampling needs only the counts."""
    from .bootstrap import spread_bootstrap

    spark = counts.sparkSession
    asked = {tuple(map(int, r)) for r in counts.select("tp", "fp", "fn").distinct().collect()}
    spread = [(c, spread_bootstrap(spark, *c)) for c in sorted(asked) if 2000 * sum(c) > SERIAL_DRAWS]
    rows = [(*c, *found) for c, found in spread] + [(*c, *bootstrap_f1(*c)) for c in sorted(asked - {c for c, _ in spread})]
    return spark.createDataFrame(rows, "tp long, fp long, fn long, low double, high double")


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """hit@k and MRR of (query, id, rank) against (query, id)."""
    best = expected.join(ranked, ["query", "id"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    return best.agg(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias("hit_at_k"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def run_status(chunks: DataFrame) -> DataFrame:
    """A run's status from its chunks: failed before interrupted before complete."""
    n = lambda s: F.count_if(F.col("status") == s)
    return chunks.groupBy("run_id").agg(F.when(n("failed") > 0, "failed").when(F.count_if(~F.col("status").isin("succeeded")) > 0, "interrupted").otherwise("complete").alias("status"), n("succeeded").alias("succeeded"), F.count("*").alias("chunks"))


def store_counts(rows: DataFrame) -> DataFrame:
    """One row: counts by status."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("proposed", "verified", "rejected")], F.count("*").alias("total"))


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts for every one of ``values``, seen or not."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna({"n": 0})

