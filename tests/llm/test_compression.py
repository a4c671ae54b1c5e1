"""Compression scores against sizes taken one text at a time, and what the samples take of long texts."""

from __future__ import annotations

import math
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from stemma.llm import compression
from stemma.llm.common import spread_pieces

WORDS = {"en": "the of and house green river with that stone".split(), "fr": "les des une maison verte rivière avec cette pierre".split(), "junk": "buy now click $$$ win free !!! cheap".split()}


def text(kind: str, seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[kind]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text("junk" if i % 2 else "en", i, 40 + i), "en", "a", "b") for i in range(60)]
    rows += [(60 + i, text("fr", i, 50), "fr", "a", "b") for i in range(30)]
    rows += [(None, text("en", 5, 50), "en", "a", "b"), (100, None, "en", "a", "b"), (101, "", "fr", "a", "b"), (102, "123 456", None, "a", "b"), (103, text("en", 9, 30_000), "en", "a", "b"), (7, text("junk", 7, 47), "en", "a", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")


def size(raw: bytes, dictionary: bytes, kind: str) -> int:
    params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT if kind == "raw" else zstandard.DICT_TYPE_FULLDICT) if dictionary else None
    if data is not None:
        data.precompute_compress(compression_params=params)
    return len(zstandard.ZstdCompressor(compression_params=params, **({"dict_data": data} if data is not None else {})).compress(raw))


def test_quality_scores_one_by_one(docs, labels):
    model = compression.fit_quality_dictionaries(docs, labels, F.col("doc_id") % 5 != 0)
    assert model.kind in ("trained", "raw")
    rows = {(r["doc_id"], r["text"]): r for r in compression.score_compression_quality(docs, model).join(docs.select("doc_id", "text"), "doc_id", "left").collect()}
    for (key, body), r in rows.items():
        if key is None:
            continue
        raw = (body or "").encode()
        x = (0.0, 0.0)
        if raw:
            g, b = size(raw, *model.good), size(raw, *model.bad)
            x = ((b - g) / (b + g), math.log(size(raw, b"", "") / len(raw)))
        want = 1 / (1 + math.exp(-(model.curve[0] * x[0] + model.curve[1] * x[1] + model.curve[2])))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == (want >= 0.3)
    assert compression.op2_compression_quality(docs, labels).where("doc_id IS NULL AND held_out IS NULL").count() == 1


def test_quality_without_labels(docs, labels):
    rows = compression.op2_compression_quality(docs, labels.limit(0)).collect()
    assert {r["model"] for r in rows} == {"plain"} and len({r["score"] for r in rows}) > 20
    one = compression.op2_compression_quality(docs, labels.where("quality = 1")).collect()
    assert {r["model"] for r in one} == {"plain"}


def test_languages_one_by_one(docs):
    models = compression.fit_languages(docs, F.lit(True), per_language=20, dictionary_bytes=20_000)
    assert sorted(models) == ["en", "fr"] and all(0 < len(d) <= 20_000 for d in models.values())
    got = compression.predict_language(docs, models)
    assert got.columns == ["doc_id", "text", "lang", "score", "lang_pred", "lang_score", "lang_rejected"]
    for r in got.collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["lang_score"], r["lang_rejected"]) == ("und", 0.0, True)
            continue
        raw = r["text"].lower().encode()
        sizes = sorted((sum(size(raw[a : a + 4096], d, "raw") for a in range(0, len(raw), 4096)), k) for k, d in models.items())
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert r["lang_pred"] == sizes[0][1] and r["lang_score"] == pytest.approx(min(1, margin / 0.2)) and r["lang_rejected"] == (margin < 0.01)


def test_every_text_has_its_share():
    made = compression.interleave([[b"a" * 10, b"b" * 10], [b"c" * 10], [b"d" * 10, b"e" * 10]], 45)
    assert made.split(b"\n") == [b"a" * 10, b"c" * 10, b"d" * 10, b"b" * 10]


def test_long_texts_are_sampled_to_their_end(spark):
    rows = [(None,), ("",), ("short",), ("ab" * 50,), ("".join(chr(97 + i // 1000) for i in range(10_000)),)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(spread_pieces(F.col("t"), 40, 4)).collect()]
    assert got[:3] == [[], [], ["short"]] and "".join(got[3]) == "ab" * 50
    assert len(got[4]) == 4 and got[4][0] == "a" * 40 and got[4][-1] == "j" * 40


def test_raw_dictionaries_have_a_share_of_every_text(monkeypatch):
    """Two long texts where training fails: both are in the dictionary."""

    def fails(*_args, **_options):
        raise zstandard.ZstdError("too little text")

    monkeypatch.setattr(zstandard, "train_dictionary", fails)
    texts = [[bytes([65 + k]) * 2048 for _ in range(60)] for k in range(2)]
    made, kind = compression.build_dictionary(texts, 112_640)
    assert kind == "raw" and made.count(b"A") > 50_000 and made.count(b"B") > 50_000


def test_language_stretches_take_turns(spark):
    """Dictionaries hold the middle and the end of sampled texts, not their beginnings alone."""
    body = "".join(c * 512 for c in "abcdefgh")
    rows = [(i, f"{body}{i:04d}", "en") for i in range(40)]
    made = compression.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_language=40, dictionary_bytes=16_000)["en"]
    assert len({c for c in b"abcdefgh" if made.count(bytes([c])) > 500}) >= 6


def test_long_labelled_texts_are_learned_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(compression, "build_dictionary", lambda texts, size: (seen.append(texts), (b"", "raw"))[1])
    docs = spark.createDataFrame([(i, text("en", i, 20_000)) for i in range(6)], "doc_id long, text string")
    compression.fit_quality_dictionaries(docs, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int"), F.lit(True))
    learned = {b"".join(pieces).decode() for texts in seen for pieces in texts}
    assert learned <= {text("en", i, 20_000) for i in range(6)} and learned
