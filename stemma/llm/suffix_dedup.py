"""Exact removal of repeated 50-byte strings, decided by suffix arrays built by linear grouping.

``suffix_array`` is the grouping construction: suffixes are grouped by Lyndon prefix. Phase 1 takes
the groups in descending order; every suffix of a group finds its previous smaller one (a pointer
to the nearest earlier suffix in a lower group) and those targets, split by how many of the group
point at them, leave their own groups for new ones just behind. Phase 2 reads the suffixes in
ascending order and hands each one's predecessors, along the same pointers, the next place of
their group. Nothing is renamed or solved recursively.

A suffix array of the whole corpus can't be cut into tasks, so only text that may repeat across
documents reaches one:

1. Documents are kept in batches (a bucketed table in the shared folder). In every 50-byte window
   the least hashed 16-byte string is its anchor; windows in a row with one anchor form a segment.
   Equal windows have equal anchors, and so lie in segments of the same anchor.
2. For each batch, anchor and distinct segment one entry goes to the anchor's bucket. Anchors of a
   single document are done with. Segments that share a window share the ``HALF`` bytes on one side
   of the anchor, so one whose hashes of both sides nobody else has is done with too: of many texts
   that hold an anchor by chance only the few that go on alike are left. Where those have one
   digest, the smallest doc_id decides for all.
3. Where they differ, each batch sends its distinct segments; a bucket builds suffix arrays over
   them, and equal 50-byte prefixes of neighbouring suffixes form the classes whose smallest
   doc_id is returned. An anchor with more than ``HOT_SEGMENTS`` segments sends single windows
   keyed by their own digest instead, so no bucket gathers a frequent passage's surroundings.
4. Batches mark the bytes of windows that a smaller doc_id holds.

Every message is one for each batch and distinct segment, so a passage that a third of all
documents share weighs no more than one entry a batch. Segments are told apart by 96-bit digests of two independent
hashes, hot windows by 128 bits of BLAKE2b; a 64-bit hash alone decides nothing (anchors that share
one only share a bucket's entry, and stretches are compared byte by byte before they are merged).

Defined cases: null text is empty; texts under 50 bytes lose nothing; a text of any length is one
document, in a batch of its own where it is longer than ``batch_bytes``; repeats inside one
document stay; rows that repeat a doc_id don't remove each other's text; a null doc_id counts as
larger than all others, and rows without one don't remove each other's text; an empty table gives
no rows. Extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import at_end, delete
from .common import _arrow_schema, persist_table, rows_to_batch, scratch_root

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
HALF = (LENGTH - GRAM) // 2  # of a window's bytes beside its anchor, so many or more stand on one side
HOT_SEGMENTS = 4096
NULL_ID = 2**63 - 1
_ONE, _NONE = 0, 1  # what an answer says of an anchor: all segments equal, or not
_HOT = 2

U = np.uint64
_STEP = int(0x9E3779B97F4A7C15)
_BACK = pow(_STEP, -1, 1 << 64)


# The suffix array -------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> list[int]:
    """Suffix array of integers >= 0; every 0 is a separator, smaller the earlier it stands.

    ``text`` must start with a separator.
    """
    n = len(text)
    chars, group_of = np.unique(text, return_inverse=True)
    sizes = np.bincount(group_of, minlength=len(chars))
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(text, kind="stable").tolist()
    group: list[int] = starts[group_of].tolist()  # a group is known by the first place of its suffixes
    size, members = [0] * n, [None] * n
    for s, k in zip(starts.tolist(), sizes.tolist()):
        size[s], members[s] = k, order[s : s + k]
    lows = int(sizes[0]) if n and chars[0] == 0 else 0
    prev = [-1] * n

    for start in range(n - 1, lows - 1, -1):  # groups in descending order
        listed = members[start]
        if listed is None:
            continue
        members[start] = None
        if len(listed) == 1:
            i = listed[0]
            if group[i] != start:
                continue
            p = i - 1
            while group[p] > start:
                p = prev[p]
            prev[i] = p
            h = group[p]
            if h >= lows and size[h] > 1:
                size[h] -= 1
                new = h + size[h]
                group[p], size[new], members[new] = new, 1, [p]
            continue
        counts: dict[int, int] = {}
        for i in listed:
            if group[i] == start:  # else it has left for a later group
                p = i - 1
                while group[p] >= start:
                    p = prev[p]
                prev[i] = p
                if group[p] >= lows:
                    counts[p] = counts.get(p, 0) + 1
        if not counts:
            continue
        by_count: dict[int, dict[int, list[int]]] = {}
        for p in sorted(counts):
            by_count.setdefault(counts[p], {}).setdefault(group[p], []).append(p)
        for k in sorted(by_count, reverse=True):
            for h, moved in by_count[k].items():
                if len(moved) < size[h]:
                    size[h] -= len(moved)
                    new = h + size[h]
                    size[new], members[new] = len(moved), moved
                    for p in moved:
                        group[p] = new

    out = [-1] * n
    out[:lows] = order[:lows]
    free = group  # the next free place is kept with the group's first place
    filled = [0] * n
    placed = bytearray(n)
    for i in order[:lows]:
        placed[i] = 1
    for at in range(-1, n):  # the end of the text comes before all suffixes
        j = (out[at] if at >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            g = free[j]
            out[g + filled[g]] = j
            filled[g] += 1
            placed[j] = 1
            j = prev[j]
    return out


def window_classes(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment, the class number of each of its windows; equal windows share a number."""
    lens = np.array([len(s) for s in segments])
    text = np.zeros(int(lens.sum()) + len(lens), np.int64)
    first = np.cumsum(lens + 1) - lens  # after each separator
    body = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    at = np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(len(body))
    text[at] = body
    room = np.zeros(len(text), np.int64)
    room[at] = np.repeat(first + lens, lens) - at
    order = np.array(suffix_array(text))
    order = order[room[order] >= LENGTH]  # only windows; equal ones stand together
    rank = np.zeros(len(text), np.int64)
    base = 0
    for a in range(0, len(order), 1 << 15):
        part = order[max(a - 1, 0) : a + (1 << 15)]
        windows = text[part[:, None] + np.arange(LENGTH)]
        new = np.concatenate([[a == 0], (windows[1:] != windows[:-1]).any(1)]) if a == 0 else (windows[1:] != windows[:-1]).any(1)
        number = base + np.cumsum(new)
        rank[part if a == 0 else part[1:]] = number
        base = int(number[-1])
    return [rank[f : f + n - LENGTH + 1] for f, n in zip(first.tolist(), lens.tolist())]


# Anchors ----------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def _slice_anchors(raw: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of the windows that fit: (first window, last window, anchor place, anchor, digest, 32 more bits of it)."""
    n = len(raw) - GRAM + 1
    x = raw.astype(U)
    x = x[:-1] | x[1:] << U(8)
    x = x[:-2] | x[2:] << U(16)
    x = x[:-4] | x[4:] << U(32)
    grams = _mix(_mix(x[:n]) * U(0x2545F4914F6CDD1D) + x[8 : 8 + n])
    others = _mix(_mix(x[8 : 8 + n] ^ U(0xA24BAED4963EE407)) * U(0x9FB21C651E98DF25) + x[:n])
    bits = U(max(n, 1).bit_length())
    least = (grams >> bits << bits) | np.arange(n, dtype=U)
    span = 1
    while span * 2 <= SPAN:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (SPAN - span)], least[SPAN - span :]) if span < SPAN else least
    start = np.flatnonzero(room[: len(least)] >= LENGTH)
    place = (least[start] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1)])) if len(start) else np.zeros(0, np.int64)
    first, last = start[new], start[np.append(new[1:], len(start))[: len(new)] - 1]
    place = place[new]
    power = np.cumprod(np.full(n, U(_STEP)))
    back = np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), U(_BACK))]))
    shape = (place - first).astype(U) * U(0xD6E8FEB86659FD93) + (last - first).astype(U)

    def digest(hashes: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[U(0)], np.cumsum(hashes * power)])
        return _mix((sums[last + SPAN] - sums[first]) * back[first] + shape)

    return first, last, place, grams[place], digest(grams), (digest(others) >> U(32)).astype(np.uint32)


def anchors(raw: np.ndarray, lens: np.ndarray, step: int = 1 << 19) -> tuple[np.ndarray, ...]:
    """Segments of documents laid end to end, in slices of bounded size."""
    ends = np.cumsum(lens)
    parts, a, n = [], 0, len(raw)
    while n - a >= LENGTH:
        b = min(n, a + step + LENGTH - 1)
        end_of = ends[np.searchsorted(ends, np.arange(a, b), "right")]
        found = _slice_anchors(raw[a:b], end_of - np.arange(a, b))
        nxt = a + step
        if b < n and len(found[0]) and found[1][-1] == step - 1:  # a segment may go on: take it up again whole
            nxt = a + int(found[0][-1])
            found = tuple(f[:-1] for f in found)
        parts.append((found[0] + a, found[1] + a, found[2] + a, *found[3:]))
        a = nxt
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (empty, empty, empty, empty.astype(U), empty.astype(U), empty.astype(np.uint32))


# Messages ---------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(_by_place(a) for a in arrays))


def _by_place(a: np.ndarray) -> bytes:
    """The items' first bytes, then their second ones: most high bytes are alike, and pack better side by side."""
    a = np.ascontiguousarray(a)
    return a.tobytes() if a.itemsize == 1 else a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    count, at = struct.unpack_from("<I", raw)[0], 4
    kinds = []
    for _ in range(count):
        kinds.append(struct.unpack_from("<2sq", raw, at))
        at += 10
    out = []
    for kind, n in kinds:
        dtype = np.dtype("<" + kind.decode())
        items = np.frombuffer(raw, dtype, n, at)
        out.append(items if dtype.itemsize == 1 else np.ascontiguousarray(items.view(np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel())
        at += n * dtype.itemsize
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """First places of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the one before it."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


class Batch:
    """Some documents: ids, lengths and bytes, with their segments."""

    def __init__(self, blob: bytes):
        self.ids, self.lens, self.raw = _unpack(blob)
        self.starts = np.cumsum(self.lens) - self.lens
        self.first, self.last, self.place, self.anchor, self.segment, self.more = anchors(self.raw, self.lens)
        self.doc = np.searchsorted(self.starts, self.first, "right") - 1
        self.doc_id = self.ids[self.doc]

    def answers(self, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each segment: what the anchor's bucket says (-1: nothing), and its smallest doc_id."""
        mode, least = np.full(len(self.anchor), -1, np.int8), np.full(len(self.anchor), NULL_ID)
        if payloads:
            keys, ids, modes = (np.concatenate(c) for c in zip(*map(_unpack, payloads)))
            order = np.argsort(keys)
            keys = keys[order]
            at = np.minimum(np.searchsorted(keys, self.anchor), len(keys) - 1)
            hit = keys[at] == self.anchor
            mode[hit], least[hit] = modes[order][at[hit]], ids[order][at[hit]]
        return mode, least


def _batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    schema = "batch long, n_bytes long, blob binary"
    out = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            blob = _pack(np.array([NULL_ID if k is None else k for k, _ in held], "<i8"), np.array([len(t) for _, t in held], "<i8"), np.frombuffer(b"".join(t for _, t in held), np.uint8))
            return rows_to_batch([(part + seq, size, blob)], out)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                if held and size + len(raw) > batch_bytes:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
                held.append((key, raw))
                size += len(raw)
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _sides(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """16-bit hashes of the ``HALF`` bytes before and after each segment's anchor; 0 where the segment has fewer."""
    end = max(len(b.raw) - 1, 0)

    def side(at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        found = np.zeros(len(at), U)
        for k in range(HALF):
            found = found * U(_STEP) + b.raw[np.clip(at + k, 0, end)]
        return np.where(inside, _mix(found) % U(65535) + U(1), U(0)).astype(np.uint16)

    after = b.place + GRAM
    return side(b.place - HALF, b.place - HALF >= b.first), side(after, after + HALF <= b.last + LENGTH)


def _send_anchors(blob: bytes, buckets: int) -> Iterator[tuple[int, bytes]]:
    """One entry for each distinct segment of the batch: anchor, digest, smallest doc_id, whether two documents, sides."""
    b = Batch(blob)
    if not len(b.anchor):
        return
    order = np.lexsort((b.more, b.segment, b.anchor))
    anchor, segment, more, ids = b.anchor[order], b.segment[order], b.more[order], b.doc_id[order]
    at = np.flatnonzero(_fresh(anchor, segment, more))
    low, high = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
    left, right = (x[order[at]] for x in _sides(b))
    entry = (anchor[at], segment[at], more[at], low, (low != high).astype(np.uint8), left, right)
    where = entry[0] % U(buckets)
    order = np.argsort(where, kind="stable")
    where = where[order]
    edges = np.append(_runs(where), len(where))
    for a, e in zip(edges[:-1], edges[1:]):
        yield int(where[a]), _pack(*(c[order[a:e]] for c in entry))


def _met(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which entries have a side in common with another of their group."""
    out = np.zeros(len(group), bool)
    for side in (left, right):
        order = np.lexsort((side, group))
        same = ~_fresh(group[order], side[order]) & (side[order] > 0)
        out[order[same]] = True
        out[order[np.flatnonzero(same) - 1]] = True
    return out


def _settle_anchors(pdf: pd.DataFrame, hot: int = HOT_SEGMENTS) -> pd.DataFrame:
    """Of one bucket: tell each batch which of its anchors have segments that may repeat across documents."""
    batches = pdf["batch"].to_numpy()
    parts = [_unpack(x) for x in pdf["payload"]]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    anchor, segment, more, low, many, left, right = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(anchor, kind="stable")
    at = _runs(anchor[order])
    count = np.diff(np.append(at, len(order)))
    shared = (np.minimum.reduceat(low[order], at) != np.maximum.reduceat(low[order], at)) | (np.maximum.reduceat(many[order], at) > 0)
    order = order[np.repeat(shared, count)]  # by anchor, then by batch
    if not len(order):
        return pd.DataFrame({"batch": [], "payload": []}).astype({"batch": "int64", "payload": "object"})
    anchor, segment, more, low, many, left, right, owner = (c[order] for c in (anchor, segment, more, low, many, left, right, owner))
    at = _runs(anchor)
    spread = lambda x: np.repeat(x, np.diff(np.append(at, len(anchor))))
    open_ = _met(spread(np.arange(len(at))), left, right) | (many > 0)
    some = np.maximum.reduceat(open_, at)
    differ = ~some
    for part in (segment, more):
        top = np.iinfo(part.dtype).max
        differ |= np.minimum.reduceat(np.where(open_, part, top), at) != np.maximum.reduceat(np.where(open_, part, part.dtype.type(0)), at)
    batch_at = np.flatnonzero(_fresh(anchor, owner))  # a batch's segments of an anchor
    mixed = np.minimum.reduceat(open_, batch_at) != np.maximum.reduceat(open_, batch_at)
    differ |= np.maximum.reduceat(np.repeat(mixed, np.diff(np.append(batch_at, len(anchor)))), at)  # an answer is the anchor's, so all of them go on
    least = np.minimum.reduceat(np.where(open_, low, NULL_ID), at)
    mode = np.where(differ, np.where(np.add.reduceat(open_.astype(np.int64), at) > hot, _HOT, _NONE), _ONE).astype(np.uint8)
    tell = np.flatnonzero(open_ & (spread(differ) | (low > spread(least)) | (many > 0)))
    tell = tell[_fresh(anchor[tell], owner[tell])]
    owner, anchor, least, mode = owner[tell], anchor[tell], spread(least)[tell], spread(mode)[tell]
    order = np.argsort(owner, kind="stable")
    edges = np.append(_runs(owner[order]), len(order))
    rows = [(int(batches[owner[order[a]]]), _pack(anchor[order[a:e]], least[order[a:e]], mode[order[a:e]])) for a, e in zip(edges[:-1], edges[1:]) if e > a]
    return pd.DataFrame(rows, columns=["batch", "payload"])


def _open_segments(b: Batch, mode: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is still to be compared: (key, digest, more of it, first byte, end byte, doc_id); hot anchors by single windows."""
    some = np.flatnonzero(mode == _NONE)
    hot = np.flatnonzero(mode == _HOT)
    counts = b.last[hot] - b.first[hot] + 1
    first = np.repeat(b.first[hot] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    digests = b"".join(hashlib.blake2b(b.raw[a : a + LENGTH].tobytes(), digest_size=16).digest() for a in first.tolist())
    windows = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return (
        np.concatenate([b.anchor[some], windows[:, 0]]),
        np.concatenate([b.segment[some], windows[:, 1]]),
        np.concatenate([b.more[some], np.zeros(len(first), np.uint32)]),
        np.concatenate([b.first[some], first]),
        np.concatenate([b.last[some], first]) + LENGTH,
        np.concatenate([b.doc_id[some], np.repeat(b.doc_id[hot], counts)]),
    )


def _send_segments(b: Batch, mode: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    key, segment, more, first, end, ids = _open_segments(b, mode)
    if not len(key):
        return
    where = key % U(buckets)
    order = np.lexsort((ids, more, segment, key, where))  # the first of equal segments has the smallest doc_id
    key, segment, more, first, end, ids, where = (c[order] for c in (key, segment, more, first, end, ids, where))
    one = _fresh(key, segment, more)
    key, segment, more, first, end, ids, where = (c[one] for c in (key, segment, more, first, end, ids, where))
    edges = np.append(_runs(where), len(where))
    for a, e in zip(edges[:-1], edges[1:]):
        text = np.frombuffer(b"".join(b.raw[x:y].tobytes() for x, y in zip(first[a:e].tolist(), end[a:e].tolist())), np.uint8)
        yield int(where[a]), _pack(key[a:e], segment[a:e], more[a:e], ids[a:e], (end - first)[a:e].astype("<i4"), text)


def _candidates(text: bytes, first: np.ndarray, windows: np.ndarray, keys: np.ndarray, block_bytes: int) -> Iterator[tuple[list[bytes], tuple[np.ndarray, np.ndarray]]]:
    """What suffix arrays must tell apart: (strings, (window numbers, their places in the strings' windows)).

    A window whose hash stands alone has no equal, so only stretches of windows with a repeated
    hash go on, and equal stretches once. Windows are numbered through, segment by segment.
    """
    raw = np.frombuffer(text, np.uint8)
    codes = _mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
    sums = np.concatenate([[U(0)], np.cumsum(codes[raw] * np.cumprod(np.full(len(raw), U(_STEP))))])
    back = np.cumprod(np.concatenate([[U(1)], np.full(len(raw), U(_BACK))]))
    span = lambda a, b: (sums[b] - sums[a]) * back[a]
    number = np.cumsum(windows) - windows
    start = np.repeat(first - number, windows) + np.arange(int(windows.sum()))
    order = np.argsort(hashed := span(start, start + LENGTH), kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    again = np.zeros(len(start), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    if not again.any():
        return
    edge = np.zeros(len(start), bool)
    edge[number[windows > 0]] = True
    opens = np.flatnonzero(again & (edge | ~np.append(False, again[:-1])))
    closes = np.flatnonzero(again & (np.append(edge[1:], True) | ~np.append(again[1:], False)))
    count = closes - opens + 1
    whole = span(start[opens], start[closes] + LENGTH)
    key = np.repeat(keys, windows)[opens]
    order = np.lexsort((whole, count, key))
    fresh = _fresh(key[order], count[order], whole[order])
    begin, end = start[opens[order]], start[closes[order]] + LENGTH
    for k in np.flatnonzero(~fresh).tolist():  # an equal hash proposes, the bytes decide
        fresh[k] = text[begin[k] : end[k]] != text[begin[k - 1] : end[k - 1]]
    lead, kind = order[fresh], np.cumsum(fresh) - 1  # distinct stretches, by key; the stretch of each in order
    sizes, a = np.cumsum(count[lead] + LENGTH - 1), 0
    edges = np.append(np.flatnonzero(fresh), len(order))
    while a < len(lead):
        e = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + block_bytes)))
        while e < len(lead) and key[lead[e]] == key[lead[e - 1]]:  # an anchor's stretches stay together
            e += 1
        strings = [text[x : y + LENGTH] for x, y in zip(start[opens[lead[a:e]]].tolist(), start[closes[lead[a:e]]].tolist())]
        place = np.cumsum(count[lead[a:e]]) - count[lead[a:e]]
        mine = slice(int(edges[a]), int(edges[e]))
        members, n = order[mine], count[order[mine]]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield strings, (np.repeat(opens[members], n) + inner, np.repeat(place[kind[mine] - a], n) + inner)
        a = e


def _settle_segments(pdf: pd.DataFrame, block_bytes: int = 1 << 18) -> pd.DataFrame:
    """Of one bucket: the smallest doc_id of every window of every segment, by suffix arrays."""
    batches = pdf["batch"].to_numpy()
    parts = [_unpack(x) for x in pdf["payload"]]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    key, segment, more, ids, size = (np.concatenate(c) for c in list(zip(*parts))[:5])
    size = size.astype(np.int64)
    text = b"".join(p[5].tobytes() for p in parts)
    first = np.cumsum(size) - size
    order = np.lexsort((ids, more, segment, key))
    fresh = _fresh(key[order], segment[order], more[order])
    kind = np.zeros(len(key), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    lead = order[fresh]  # of each distinct segment, the entry with the smallest doc_id
    windows = size[lead] - LENGTH + 1
    places = np.cumsum(windows) - windows
    least = np.repeat(ids[lead], windows)
    for segments, at in _candidates(text, first[lead], windows, key[lead], block_bytes):
        classes = np.concatenate(window_classes(segments))
        low = np.full(int(classes.max()) + 1, NULL_ID)
        np.minimum.at(low, classes[at[1]], least[at[0]])
        least[at[0]] = low[classes[at[1]]]
    rows = []
    order = np.argsort(owner, kind="stable")
    edges = np.append(_runs(owner[order]), len(order))
    for a, e in zip(edges[:-1], edges[1:]):
        mine = order[a:e]
        k = kind[mine]
        take = np.repeat(places[k] - (np.cumsum(windows[k]) - windows[k]), windows[k]) + np.arange(int(windows[k].sum()))
        rows.append((int(batches[owner[mine[0]]]), _pack(key[mine], segment[mine], more[mine], windows[k], least[take])))
    return pd.DataFrame(rows, columns=["batch", "payload"])


def _finish(b: Batch, mode: np.ndarray, least: np.ndarray, payloads: list[bytes]) -> np.ndarray:
    """Which bytes of the batch go."""
    covered = np.zeros(len(b.raw) + 1, np.int64)
    whole = np.flatnonzero((mode == _ONE) & (b.doc_id > least))
    np.add.at(covered, b.first[whole], 1)
    np.add.at(covered, b.last[whole] + LENGTH, -1)
    if payloads:
        key, segment, more, first, _, ids = _open_segments(b, mode)
        keys, segments, mores, windows, low = (np.concatenate(c) for c in zip(*map(_unpack, payloads)))
        places = np.cumsum(windows) - windows
        known = {x: i for i, x in enumerate(zip(keys.tolist(), segments.tolist(), mores.tolist()))}
        at = np.fromiter((known[x] for x in zip(key.tolist(), segment.tolist(), more.tolist())), np.int64, len(key))
        n = windows[at]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone = low[np.repeat(places[at], n) + inner] < np.repeat(ids, n)
        start = (np.repeat(first, n) + inner)[gone]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + LENGTH, -1)
    return np.cumsum(covered[:-1]) > 0


def _digests(b: Batch, gone: np.ndarray) -> Iterator[tuple]:
    for key, at, n in zip(b.ids.tolist(), b.starts.tolist(), b.lens.tolist()):
        cut = gone[at : at + n]
        removed = int(cut.sum())
        spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + cut[0]) if removed else 0
        kept = b.raw[at : at + n][~cut] if removed else b.raw[at : at + n]
        yield (None if key == NULL_ID else key, n, removed, spans, kept.tobytes())


def remove_repeats(docs: DataFrame, batch_bytes: int = 2 << 20, bucket_bytes: int = 16 << 20, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stemma_batches_{uuid.uuid4().hex}"
    # A bucketed table: both later passes over the texts find them where they lie.
    _batches(docs, batch_bytes).write.bucketBy(shuffles, "batch").option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
    at_end(lambda: (spark.sql(f"DROP TABLE IF EXISTS {name}"), delete(spark, f"{scratch_root(spark)}/{name}")))
    texts = spark.table(name)
    total = texts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(3 * shuffles, -(-total // bucket_bytes))
    message = "bucket int, batch long, payload binary"
    sent = _arrow_schema(spark, message)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield rows_to_batch([(bucket, key, payload) for bucket, payload in _send_anchors(blob, buckets)], sent)

    asked = texts.select("batch", "blob").mapInArrow(ask, message)
    anchored = persist_table(asked.groupBy("bucket").applyInPandas(lambda pdf: _settle_anchors(pdf, hot_segments), "batch long, payload binary"), "anchors", free=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob, told in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = Batch(blob)
                yield rows_to_batch([(bucket, key, payload) for bucket, payload in _send_segments(b, b.answers(told)[0], buckets)], sent)

    gathered = anchored.groupBy("batch").agg(F.collect_list("payload").alias("told"))  # of one batch's own size
    compared = texts.join(gathered, "batch").select("batch", "blob", "told").mapInArrow(compare, message)
    settled = compared.groupBy("bucket").applyInPandas(lambda pdf: _settle_segments(pdf), "batch long, payload binary")

    both = anchored.select("batch", F.lit(0).alias("kind"), "payload").unionByName(settled.select("batch", F.lit(1).alias("kind"), "payload"))
    told = both.groupBy("batch").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("payload"))).alias(f"told{k}") for k in (0, 1)])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    out = _arrow_schema(spark, schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, anchors_told, segments_told in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = Batch(blob)
                mode, least = b.answers(anchors_told or [])
                yield rows_to_batch(_digests(b, _finish(b, mode, least, segments_told or [])), out)

    return texts.join(told, "batch", "left").select("blob", "told0", "told1").mapInArrow(finish, schema)


def op6_suffix_array_dedup(docs: DataFrame, **options) -> DataFrame:
    found = remove_repeats(docs, **options)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
