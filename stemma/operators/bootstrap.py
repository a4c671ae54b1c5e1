"""The seed's bootstrap in many tasks: one Mersenne Twister stream, cut into stretches that tasks jump to.

The generator is linear over GF(2): its words obey one recurrence of degree 19,937, so the word that
stands J places on is a sum (exclusive or) of at most 19,937 words from here, those that x^J modulo
the recurrence's polynomial names. The polynomial is found from the generator's own output
(Berlekamp-Massey) and the power by squaring, so a task reaches its stretch in about a second
however far out it is.

Values of ``total`` or more are drawn again, so where a stretch's draws belong depends on how many
were accepted before it: a first pass counts them and their hits by stretch, their running sums are
the places, and a second pass deals out to the samples what lies in stretches of several samples.
The result is the serial stream's, draw by draw.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS, DEGREE = 624, 19_937
#: Raw draws of a stretch (a smaller bootstrap is one), and of what is looked at in one go.
STRETCH, CHUNK = 1 << 21, 1 << 16


def _generator(key: np.ndarray, pos: int) -> np.random.MT19937:
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": pos}}
    return out


@lru_cache(maxsize=4)
def _words(seed: int) -> np.ndarray:
    """The generator's words before tempering: those it is seeded with, and as many after as a jump takes."""
    state = random.Random(seed).getstate()[1]
    key = np.array(state[:-1], np.uint32)
    source, out = _generator(key, WORDS), [key]
    for _ in range(-(-(DEGREE + WORDS) // WORDS) + 1):
        source.random_raw(WORDS)
        out.append(source.state["state"]["key"].copy())
    return np.concatenate(out)


@lru_cache(maxsize=1)
def _polynomial() -> int:
    """The recurrence's polynomial, bit i for x^i, from one bit of 2 * ``DEGREE`` words and some."""
    state = random.Random(1).getstate()[1]
    source, bits = _generator(np.array(state[:-1], np.uint32), WORDS), []
    while len(bits) < 2 * DEGREE + 64:
        source.random_raw(WORDS)
        bits += (source.state["state"]["key"] & 1).tolist()
    now, last, length, since, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits[: 2 * DEGREE + 64]):
        seen = seen << 1 | bit
        if (now & seen).bit_count() & 1:
            kept = now
            now ^= last << since
            if 2 * length <= n:
                length, last, since = n + 1 - length, kept, 0
        since += 1
    if length != DEGREE:
        raise RuntimeError(f"a recurrence of degree {length} was found")
    return int(bin(now)[2:].zfill(DEGREE + 1)[::-1], 2)


def _power(places: int) -> int:
    """x^places modulo the polynomial."""
    p = _polynomial()

    def rest(a: int) -> int:
        while (d := a.bit_length() - 1) >= DEGREE:
            a ^= p << (d - DEGREE)
        return a

    out = 1
    for digit in bin(places)[2:]:
        out = rest(int("0".join(bin(out)[2:]), 2))  # squaring puts a nought between any two digits
        if digit == "1":
            out = rest(out << 1)
    return out


def draws_from(seed: int, first: int) -> np.random.MT19937:
    """The seed's generator after ``first`` raw draws."""
    words = _words(seed)
    if not first:
        return _generator(words[:WORDS], WORDS)
    named = np.flatnonzero(np.frombuffer(bin(_power(first))[:1:-1].encode(), np.uint8) == ord("1"))
    key = np.zeros(WORDS, np.uint32)
    for k in named.tolist():
        key ^= words[WORDS + k : 2 * WORDS + k]
    return _generator(key, 0)


def _chunks(source: np.random.MT19937, size: int) -> Iterator[np.ndarray]:
    """The next ``size`` raw draws, in pieces that stay in a processor's cache."""
    draw = np.random.Generator(source)
    for at in range(0, size, CHUNK):
        yield draw.integers(0, 1 << 32, min(CHUNK, size - at), np.uint32)


def _key(source: np.random.MT19937) -> tuple[bytes, int]:
    state = source.state["state"]
    return state["key"].astype("<u4").tobytes(), int(state["pos"])


def spread_bootstrap(spark: SparkSession, tp: int, fp: int, fn: int, draws: int = 2000, seed: int = 7, stretch: int = STRETCH) -> tuple[float, float]:
    """``quality.bootstrap_f1`` with a task for every run of the stream's stretches.

    A task jumps to its first stretch only and then draws on. What it says of a stretch is its
    accepted draws, its hits and the generator's state at its start, so that the second pass draws
    only the stretches anew in which one sample ends and the next begins, of which there are as many
    as samples at most however many outcomes there are.
    """
    from ..plans.checkpoints import cut
    from .quality import interval_of

    total = tp + fp + fn
    if not 0 < total < 2**32:
        raise ValueError("outcomes must number 1 to 2^32 - 1")
    wanted, chance = draws * total, total / 2 ** total.bit_length()
    raw = wanted / chance
    count = int((raw + 12 * (raw * (1 - chance) / chance) ** 0.5) // stretch) + 1
    shift = 32 - total.bit_length()
    above, good = total << shift, tp << shift  # a raw draw's leading bits are below a number where it is below this

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, at = None, -1
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                if i != at:
                    source = draws_from(seed, i * stretch)
                key, pos = _key(source)
                n = hits = 0
                for drawn in _chunks(source, stretch):
                    n += int(np.count_nonzero(drawn < above)) if above < 1 << 32 else len(drawn)
                    hits += int(np.count_nonzero(drawn < good)) if good < 1 << 32 else len(drawn)
                rows.append((i, n, hits, key, pos))
                at = i + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["id", "n", "hits", "key", "pos"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, pos, before in zip(*(c.to_pylist() for c in batch.columns)):
                source = _generator(np.frombuffer(key, "<u4").astype(np.uint32), pos)
                first, at = before // total, before
                hits = np.zeros(stretch // total + 2, np.int64)
                misses = np.zeros_like(hits)
                for drawn in _chunks(source, stretch):
                    drawn = (drawn >> np.uint32(shift))[: max(0, wanted - at)] if above == 1 << 32 else (drawn[drawn < above] >> np.uint32(shift))[: max(0, wanted - at)]
                    sample = (at + np.arange(len(drawn))) // total - first
                    hit = drawn < tp
                    hits += np.bincount(sample[hit], minlength=len(hits))
                    misses += np.bincount(sample[~hit], minlength=len(hits))
                    at += len(drawn)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(hits))), pa.array(hits), pa.array(misses)], names=["sample", "hits", "misses"])

    tasks = min(count, 4 * spark.sparkContext.defaultParallelism)  # each a run of neighbours, and one jump
    stretches = spark.range(0, count, 1, tasks)
    counts = cut(stretches.mapInArrow(counted, "id long, n long, hits long, key binary, pos int"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a stretch, no states
    placed = counts.select("id", "n", "hits", before.alias("before")).where(F.col("before") < wanted)
    sample = F.expr(f"before DIV {total}")
    inside = F.expr(f"(before + greatest(n, 1) - 1) DIV {total}") == sample
    whole = placed.where(inside).select(sample.alias("sample"), "hits", (F.col("n") - F.col("hits")).alias("misses"))
    parted = placed.where(~inside).select("id", "before").join(counts.select("id", "key", "pos"), "id").select("key", "pos", "before").repartition(tasks)
    got: DataFrame = whole.unionByName(parted.mapInArrow(dealt, "sample long, hits long, misses long")).groupBy("sample").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    rows = got.where(F.col("sample") < draws).orderBy("sample").toPandas()  # a row a sample
    hits, misses = rows["hits"].to_numpy(), rows["misses"].to_numpy()
    if len(rows) != draws or (hits + misses != total).any():
        raise RuntimeError("the stretches held fewer draws than were wanted")
    return interval_of(hits, misses)
