"""Best-fit packing with a Martello-Toth style dominance reduction, over length counts.

Only how many pieces have each length matters to a packing, so the instance is the histogram of
piece lengths (at most ``capacity`` numbers, whatever the corpus holds) and a solution is a list of
patterns with multiplicities. The reduction takes each length s, longest first, with room r:

* nothing fits beside s: the pattern {s} is fixed;
* a piece of length exactly r exists: {s, r} fills the sequence and dominates every other use of s;
* at most one more piece fits (the two shortest exceed r): {s, longest <= r} dominates;
* at most two more fit and the longest single l <= r is no shorter than any fitting pair's sum:
  {s, l} dominates.

A fixed pattern is applied as often as counts allow and the instance shrinks; lengths that no rule
settles stay in it (and may still be partners), and best-fit decreasing packs the remainder on
counts as well.

Pieces then find their place by (length, rank among the pieces of that length): ranks come from
counts for each writer partition, so no length, however common, is ever gathered in one task.
The plan has at most a few entries for each length and is the only thing broadcast.

Defined cases: null text is empty (one piece holding the end id); a text of any length is encoded
whole and cut into as many pieces as it takes; an empty table gives no rows; rows that repeat, or
that share a doc_id, are separate documents; a null doc_id is carried through; pieces of equal
length are interchangeable and take their places in the writers' order. Extra columns of any name
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, persist_table, rows_to_batch, trim_worker
from .tokens import CACHE_PIECES, default_path, encoder, slices

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def cut_lengths(n: int, capacity: int) -> list[int]:
    """A document's piece lengths: only longer ones are cut, and the first piece takes the remainder."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def dominance_reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], Counter]:
    """Fix dominating patterns; returns them with multiplicities, and the counts that no rule settles."""
    left = Counter({k: v for k, v in counts.items() if v})
    fixed: list[tuple[Pattern, int]] = []
    lengths = sorted(left)  # every length with pieces left, settled or not

    def take(pattern: Pattern, times: int) -> None:
        fixed.append((pattern, times))
        for length, copies in pattern:
            left[length] -= copies * times
            if not left[length]:
                lengths.remove(length)

    for s in sorted(left, reverse=True):
        room = capacity - s
        while n := left[s]:
            others = lambda x: left[x] - (x == s)
            least: list[int] = []  # the three shortest pieces beside s
            for x in lengths:
                least += [x] * min(3, others(x))
                if len(least) >= 3:
                    break
            fits = bisect_right(lengths, room)
            if fits and not others(lengths[fits - 1]):
                fits -= 1
            if not fits:
                take(((s, 1),), n if not least or least[0] > room else 1)
                continue
            pair = lengths[fits - 1]
            one_more = len(least) < 2 or least[0] + least[1] > room
            two_more = len(least) < 3 or sum(least[:3]) > room
            if pair == room or one_more or two_more and pair >= _best_pair(lengths, others, room):
                take(((s, 2),) if pair == s else tuple(sorted(((s, 1), (pair, 1)), reverse=True)), n // 2 if pair == s else min(n, left[pair]))
            else:
                break
    return fixed, Counter({k: v for k, v in left.items() if v})


def _best_pair(lengths: list[int], others: Callable[[int], int], room: int) -> int:
    """The largest sum of two pieces within ``room``."""
    best, lo, hi = 0, 0, len(lengths) - 1
    while lo <= hi:
        total = lengths[lo] + lengths[hi]
        if total > room or not others(lengths[hi]) or lo == hi and others(lengths[lo]) < 2:
            hi -= 1
        elif not others(lengths[lo]):
            lo += 1
        else:
            best = max(best, total)
            lo += 1
    return best


def best_fit_decreasing(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: open sequences are kept as classes of equal content."""
    open_by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_by_room[room].append((pattern, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_right(rooms, s - 1)
            if at == len(rooms):
                fit = capacity // s
                full, part = divmod(n, fit)
                if full:
                    put(capacity - fit * s, ((s, fit),), full)
                if part:
                    put(capacity - part * s, ((s, part),), 1)
                n = 0
                continue
            room = rooms[at]
            pattern, times = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            fit = room // s
            if n >= times * fit:
                put(room - fit * s, (*pattern, (s, fit)), times)
                n -= times * fit
            else:
                full, part = divmod(n, fit)
                if full:
                    put(room - fit * s, (*pattern, (s, fit)), full)
                if part:
                    put(room - part * s, (*pattern, (s, part)), 1)
                if times - full - bool(part):
                    put(room, pattern, times - full - bool(part))
                n = 0
    return [x for classes in open_by_room.values() for x in classes]


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, rest = dominance_reduce(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def _slots(plan: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: (first rank, first sequence, copies in a sequence, offset of the first copy)."""
    used: Counter = Counter()
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length, copies in pattern:
            by_length.setdefault(length, []).append((used[length], sequence, copies, offset))
            used[length] += copies * times
            offset += length * copies
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in by_length.items()}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """One row a piece, with the writer's partition and the piece's rank among its length there."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    out = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path, cache_pieces), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for keys, texts in slices(batches):
            rows = []
            for key, ids in zip(keys, enc.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for piece, n in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append((key, piece, at, n, zlib.crc32(ids[at : at + n].tobytes()), part, seen[n]))
                    seen[n] += 1
                    at += n
            yield rows_to_batch(rows, out)
        trim_worker()  # the encoder stays, what its batches took goes

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = persist_table(token_pieces(docs, tokenizer_path or default_path(), capacity, end_id, cache_pieces), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(_slots(plan_packing(counts, capacity)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, seq, copies, off = slots.value[int(n)]
                at = np.searchsorted(first, rank[rows], "right") - 1
                k = rank[rows] - first[at]
                sequence[rows] = seq[at] + k // copies[at]
                offset[rows] = off[at] + k % copies[at] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=out)

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, schema)


def op7_best_fit_packing(docs: DataFrame, **options) -> DataFrame:
    return pack_documents(docs, **options)
