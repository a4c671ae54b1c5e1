"""Alignment of two tokenizers against the libraries on whole texts and plain loops over byte offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stemma.llm import alignment, queries

from ..conftest import DATA

SCHEMA = "doc_id long, text string, n_a string, links int"
ODD = [
    (0, None),
    (1, ""),
    (2, " "),
    (3, "  two  spaces  "),
    (4, "\n\ttabs\nand lines \n"),
    (5, "a low▁line is no space"),
    (6, "x<|endoftext|>y <s> </s> <0x41> <unk>"),
    (7, "日本語のテキスト と 漢字"),
    (8, "émigré naïve ﬁ é 🙂🙃 ‍﻿"),
    (9, "short"),
    (9, "short"),
    (None, "short tokens, tokenizers; token!"),
    (11, "A" * 5000),
    (12, "!!! ??? ### 12345678 0x1F"),
    (13, "　wide and odd spaces\x1c\x85 end"),
    (14, "it's don't we'll they've"),
    (15, "\x00null\x00 byte"),
]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    spell = {v: k for k, v in alignment.byte_alphabet().items()}
    back = {c: b for b, c in spell.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    names = {i: t for t, i in a.get_vocab().items()}

    def encode(text):
        if not text:
            return [], []
        one = [(i, bytes(back[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        raw = (" " + text).encode()
        return (one, two) if b"".join(t for _, t in one) == raw == b"".join(t for _, t in two) else ([], [])

    return encode


def brute(rows, encode):
    """Per row: n_a, n_b, n_groups, links, written groups."""
    out = []
    for _, text in rows:
        one, two = encode(text)
        ends = lambda tokens: [(i, e) for (i, _), e in zip(tokens, np.cumsum([len(t) for _, t in tokens]).tolist())]
        ea, eb = ends(one), ends(two)
        cuts = sorted({e for _, e in ea} & {e for _, e in eb})
        at_b = {e: i for i, e in eb}
        links = [(i, at_b[e]) for i, e in ea if e in at_b]
        groups = [([], []) for _ in cuts]
        for side, tokens in enumerate((ea, eb)):
            at = 0
            for i, e in tokens:
                groups[at][side].append(str(i))
                at += e == cuts[at]
        groups = [",".join(x) + "|" + ",".join(y) for x, y in groups]
        out.append((len(one), len(two), len(cuts), links, ";".join(groups)))
    return out


def expected(rows, encode):
    found = brute(rows, encode)
    counts = Counter(link for *_, links, _ in found for link in links)
    top: dict[int, int] = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (k, n_a, n_b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for (k, _), (n_a, n_b, g, links, text) in zip(rows, found)
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r))


def test_align_bytes_by_hand():
    last_a, last_b, (a, b, n) = alignment.align_bytes(np.array([3, 2, 4]), np.array([1, 2, 6]))
    assert (last_a.tolist(), last_b.tolist()) == ([0, 2], [1, 2])
    assert list(zip(a.tolist(), b.tolist(), n.tolist())) == [(0, 0, 1), (0, 1, 2), (1, 2, 2), (2, 2, 4)]
    with pytest.raises(ValueError):
        alignment.align_bytes(np.array([3]), np.array([2]))


def test_op12_odd_rows(spark, libraries):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in ODD], SCHEMA).repartition(3)
    got = alignment.op12_token_alignment(df).select(*COLUMNS).collect()
    assert order(map(tuple, got)) == order(expected(ODD, libraries))
    assert [r["n_a"] for r in got if r["doc_id"] == 5] == [0]


def test_op12_empty_table(spark):
    assert alignment.op12_token_alignment(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op12_very_long_texts(spark, libraries):
    rng = random.Random(2)
    rows = [(1, " ".join(rng.choice(["stone", "river", "über", "x9,", "tion", "a\nb"]) for _ in range(150_000))), (2, "nospaces" * 40_000)]
    got = alignment.op12_token_alignment(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(tuple(r[c] for c in COLUMNS) for r in got) == order(expected(rows, libraries))


def test_op12_whole_table(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.queries()["op12_token_alignment"](spark, DATA).collect()
    assert order(tuple(r[c] for c in COLUMNS) for r in got) == order(expected(docs, libraries))


def test_align_documents_spells_the_text(spark, libraries):
    got = {r["doc_id"]: r for r in alignment.align_documents(spark.createDataFrame(ODD[:9], "doc_id long, text string")).collect()}
    for (k, text), (_, _, g, _, written) in zip(ODD[:9], brute(ODD[:9], libraries)):
        r = got[k]
        assert len(r["group_a"]) == len(r["group_b"]) == g and sum(r["group_a"]) == len(r["a_ids"]) and sum(r["group_b"]) == len(r["b_ids"])
        assert sum(o["bytes"] for o in r["overlaps"]) == (len((" " + text).encode()) if written else 0)
        assert len({(o["a"], o["b"]) for o in r["overlaps"]}) == len(r["overlaps"]) and {o["a"] for o in r["overlaps"]} == set(range(len(r["a_ids"])))


def test_link_counts_settle_often(monkeypatch):
    monkeypatch.setattr(alignment, "PENDING", 10)
    rng = np.random.default_rng(1)
    counts, seen = alignment._LinkCounts(), Counter()
    for _ in range(40):
        links = rng.integers(0, 12, 7)
        counts.add(links)
        seen.update(links.tolist())
    counts.settle()
    assert dict(zip(counts.codes.tolist(), counts.counts.tolist())) == dict(seen)


def test_encoders_start_afresh(libraries, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(alignment, "CACHE_IDS", 20)
    both = alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    for _ in range(3):
        x = both.align([t for _, t in ODD if t])
        assert both.written_groups(x) == [w.encode() for *_, w in brute([r for r in ODD if r[1]], libraries)]
