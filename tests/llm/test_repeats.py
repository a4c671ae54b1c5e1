"""Repeated strings with hot anchors, and with hashes that collide on purpose."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from stemma.llm import suffix_dedup as S

from .test_llm import by_id, prose, repeats


def corpus(n: int) -> list[tuple[int, str]]:
    rng = random.Random(9)
    pool = [prose(i, 40) for i in range(5)]
    rows = []
    for k in range(n):
        p, a = rng.choice(pool), rng.randint(0, 80)
        rows.append((k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) + p[a : a + rng.randint(30, 120)] + "".join(rng.choice("xyz ") for _ in range(20))))
    return [*rows, (n, rows[0][1]), (n + 1, rows[3][1]), (n + 2, "")]


@pytest.mark.parametrize("hot", [4096, 2])
def test_hot_anchors(spark, hot):
    rows = corpus(60)
    got = S.op6_suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch_bytes=2000, hot_segments=hot)
    assert by_id(got) == repeats(rows)


def by_hand(rows: list[tuple[int, str]], size: int, hot: int, buckets: int = 3) -> list[tuple]:
    """The operator's own steps, one after the other in this process."""
    blobs = []
    for a in range(0, len(rows), size):
        raw = [(k, t.encode()) for k, t in rows[a : a + size]]
        blobs.append(S._pack(np.array([k for k, _ in raw], "<i8"), np.array([len(t) for _, t in raw], "<i8"), np.frombuffer(b"".join(t for _, t in raw), np.uint8)))

    def settle(sent, f):
        told = {n: [] for n in range(len(blobs))}
        for bucket in range(buckets):
            mine = [(n, payload) for n, found in enumerate(sent) for b, payload in found if b == bucket]
            if mine:
                for r in f(pd.DataFrame(mine, columns=["batch", "payload"])).itertuples():
                    told[r.batch].append(r.payload)
        return told

    anchored = settle([list(S._send_anchors(blob, buckets)) for blob in blobs], lambda pdf: S._settle_anchors(pdf, hot))
    batches = [S.Batch(blob) for blob in blobs]
    answers = [b.answers(anchored[n]) for n, b in enumerate(batches)]
    settled = settle([list(S._send_segments(b, mode, buckets)) for b, (mode, _) in zip(batches, answers)], S._settle_segments)
    import hashlib

    out = []
    for n, (b, (mode, least)) in enumerate(zip(batches, answers)):
        out += [(k, size_, removed, spans, hashlib.sha256(kept).hexdigest()) for k, size_, removed, spans, kept in S._digests(b, S._finish(b, mode, least, settled[n]))]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("bits", [64, 6])
def test_colliding_hashes(monkeypatch, hot, bits):
    """With six bits left of the first digest and of the stretches' hash, the rest of the digest and the bytes decide."""
    whole = S._slice_anchors
    weak = lambda raw, room: (*(f := whole(raw, room))[:4], f[4] >> S.U(64 - bits), f[5])
    monkeypatch.setattr(S, "_slice_anchors", weak)
    rows = corpus(80)
    assert by_hand(rows, 9, hot) == repeats(rows)


def test_equal_stretch_hashes_are_compared_byte_by_byte(monkeypatch):
    monkeypatch.setattr(S, "_STEP", 1)  # sums of codes only: anagrams collide
    monkeypatch.setattr(S, "_BACK", 1)
    rng = random.Random(2)
    base = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(6)]
    segments = [*base, *base, *(bytes(sorted(x)) for x in base), *(x[::-1] for x in base)]
    text = b"".join(segments)
    first = np.cumsum([0] + [60] * (len(segments) - 1))
    windows = np.full(len(segments), 60 - S.LENGTH + 1)
    seen: dict[bytes, set[int]] = {}
    done = set()
    for strings, (numbers, places) in S._candidates(text, first, windows, np.zeros(len(segments), S.U), 1 << 18):
        flat = [s[i : i + S.LENGTH] for s in strings for i in range(len(s) - S.LENGTH + 1)]
        for number, place in zip(numbers.tolist(), places.tolist()):
            a = number // 11 * 60 + number % 11
            assert flat[place] == text[a : a + S.LENGTH]
            done.add(number)
    for number in range(len(segments) * 11):
        a = number // 11 * 60 + number % 11
        seen.setdefault(text[a : a + S.LENGTH], set()).add(number)
    assert {n for same in seen.values() if len(same) > 1 for n in same} <= done


def test_anchors_shared_by_chance_send_no_segments():
    """Texts that have single words in common, but no 50 bytes, are done with after their anchors; copies among them by digest."""
    rng = random.Random(4)
    phrases = ["".join(rng.choice("abcdefghij") for _ in range(17)) + " " for _ in range(40)]
    rows = [(k, " ".join("".join(rng.choice("klmnopqrst") for _ in range(18)) + " " + rng.choice(phrases) for _ in range(20))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    assert by_hand(rows, 7, 4096) == repeats(rows)
    blobs = [S._pack(np.array([k], "<i8"), np.array([len(t)], "<i8"), np.frombuffer(t.encode(), np.uint8)) for k, t in rows]
    asked = pd.DataFrame([(n, payload) for n, blob in enumerate(blobs) for _, payload in S._send_anchors(blob, 1)], columns=["batch", "payload"])
    told = S._settle_anchors(asked)
    open_ = [m for payload in told["payload"] for m in S._unpack(payload)[2].tolist()]
    assert open_.count(S._ONE) > 100 and open_.count(S._NONE) < 50  # some hundreds otherwise
