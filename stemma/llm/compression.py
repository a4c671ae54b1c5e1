"""Zstandard dictionaries as classifiers: quality (good against bad) and language.

Quality: two dictionaries are built from bounded samples of good and bad labelled text. A text's
signal is (size with bad - size with good) / (their sum). A logistic curve fitted on sampled rows
that gave neither dictionary anything turns it into a score; the log ratio that the text reaches
without a dictionary is the curve's second input, since endless repetition fits any dictionary
equally. Where a class has too little text for trained dictionaries its dictionary is the sampled
text itself (raw content); ``model`` says which kind scored (``trained``, ``raw``, ``plain``).

Language: each language has a raw-content dictionary of sampled text; the smallest encoding names
the language. Texts are lower-cased on both sides and encoded in blocks of ``BLOCK_BYTES``, each from
the bare dictionary, so that what a dictionary saves grows with the text and the margin doesn't fall
with length; sizes are summed over the blocks. The margin to the runner-up, relative to it, is scored and narrow ones rejected.

Samples are bounded in rows: ``per_class`` for quality, whose sampled texts are learned whole, and
``per_language``. A language's dictionary holds ``dictionary_bytes``, less than its sampled texts
have, so every text gives stretches of its own: of up to ``PIECES`` spread over it the dictionary
takes them in turn, beginning with another one from text to text. Scoring takes whole texts.

Defined cases: null and empty texts have signal 0 (quality) and are ``und`` with score 0
(language), as are texts without a letter; texts of any length are compressed whole, quality in
one frame and language block by block; equal sizes go to the language that sorts first, with
margin 0; one learned language leaves no runner-up and margin 1. Without labels of both classes
the plain ratio alone scores (``PLAIN_CURVE``); where the rows kept for the curve lack a class, all
sampled rows fit it; without learned languages every text is ``und``. Repeated rows, and rows with
a null or repeated doc_id, are scored alike; a repeated doc_id or text is learned from once; an
empty table gives no rows and an empty sample. Extra columns are ignored by the queries and kept by
``predict_language``, whose own columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, alone, fold, spread_pieces, with_columns_schema
from .quality_rules import balanced_sample, labelled_ids

#: Quality: a sampled text is learned whole, in consecutive pieces of so many characters.
PIECE_CHARS = 2048
#: Language: stretches of a sampled text, so many of so many characters, spread over all of it; which ones a dictionary takes turns from text to text.
PIECES, LANGUAGE_PIECE_CHARS = 8, 512
#: The curve of a model without labels of both classes: (signal, log ratio, intercept).
PLAIN_CURVE = (0.0, 1.5, 2.0)
#: Languages are told on blocks of this many bytes, summed over the whole text.
BLOCK_BYTES = 4096
UND = "und"


def _compressor(dictionary: bytes, raw: bool):
    import zstandard as z

    kind = z.DICT_TYPE_RAWCONTENT if raw else z.DICT_TYPE_FULLDICT
    d = z.ZstdCompressionDict(dictionary, dict_type=kind)
    params = z.ZstdCompressionParameters.from_level(3, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=d, compression_params=params)


# Quality ------------------------------------------------------------------------------------


def build_dictionary(texts: list[list[bytes]], size: int) -> tuple[bytes, str]:
    """(dictionary, kind) of texts in pieces: trained on all pieces, or a share of each text where they are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, [p for pieces in texts for p in pieces], k=256, d=8).as_bytes(), "trained"
    except zstandard.ZstdError:  # too little text for statistics
        return interleave(texts, size), "raw"


def _coder(dictionary: bytes, kind: str):
    return _compressor(dictionary, raw=kind == "raw") if dictionary else _plain()


def signal(text: str | None, good, bad, plain) -> tuple[float, float]:
    """(normalised size difference, log of the size share without a dictionary)."""
    raw = (text or "").encode()
    if not raw:
        return 0.0, 0.0
    g, b = len(good.compress(raw)), len(bad.compress(raw))
    return (b - g) / (b + g), float(np.log(len(plain.compress(raw)) / len(raw)))


def _plain():
    import zstandard as z

    return z.ZstdCompressor(compression_params=z.ZstdCompressionParameters.from_level(3, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Slopes and, last, the intercept, by Newton's method with step halving."""
    scale = np.maximum(np.abs(x).max(0, initial=0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])

    def loss(b: np.ndarray) -> float:
        m = z @ b
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + l2 * (b @ b) / 2)

    b = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(b))
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - l2 * b)
        t = 1.0
        while t > 1e-6 and loss(b + t * step) > loss(b):
            t /= 2
        b = b + t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return np.append(b[:-1] / scale, b[-1])


@dataclass
class QualityModel:
    """Dictionaries (bytes, kind) of good and bad text, and the curve's slopes and intercept."""

    good: tuple[bytes, str]
    bad: tuple[bytes, str]
    curve: tuple[float, ...]

    @property
    def kind(self) -> str:
        kinds = {k for d, k in (self.good, self.bad) if d}
        return "plain" if not (self.good[0] and self.bad[0]) else "raw" if "raw" in kinds else "trained"

    def signals(self, texts: list[str | None]) -> np.ndarray:
        good, bad, plain = _coder(*self.good), _coder(*self.bad), _plain()
        return np.array([signal(t, good, bad, plain) for t in texts]).reshape(-1, 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve[:-1]) + self.curve[-1], -700, 700)))


def fit_quality_dictionaries(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", per_class: int = 1500, dictionary_bytes: int = 112_640) -> QualityModel:
    """Learned from at most ``per_class`` labelled documents a class, chosen by key hash.

    What reaches the driver is these documents' texts for the dictionaries and two numbers of each
    for the curve.
    """
    chosen, totals = balanced_sample(labelled_ids(labels, label).where(keep), per_class)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0).withColumn("part", part)  # at most 2 * per_class ids
    pieces = sample.where("part > 0").select("doc_id", "y", F.col("text"))
    rows = sorted(tuple(r) for r in pieces.groupBy("doc_id", "y").agg(F.min("text")).collect())
    whole = lambda t: [t[a : a + PIECE_CHARS].encode() for a in range(0, len(t), PIECE_CHARS)]
    good, bad = (build_dictionary([whole(t) for _, k, t in rows if k == y], dictionary_bytes) for y in (1, 0))
    model = QualityModel(good, bad, PLAIN_CURVE)
    if model.kind == "plain":
        return model
    found = _signals(sample, model)
    held = found.where("part = 0").select("doc_id", "y", "x0", "x1").groupBy("doc_id", "y").agg(F.min(F.struct("x0", "x1")).alias("x"))
    got = sorted((r["doc_id"], r["y"], *r["x"]) for r in held.collect())
    if len({y for _, y, _, _ in got}) < 2:
        every = found.groupBy("doc_id", "y").agg(F.min(F.struct("x0", "x1")).alias("x"))
        got = sorted((r["doc_id"], r["y"], *r["x"]) for r in every.collect())
    x, y = np.array([r[2:] for r in got], float).reshape(-1, 2), np.array([r[1] for r in got], float)
    weight = np.where(y == 1, totals.get(1, 0) / max((y == 1).sum(), 1), totals.get(0, 0) / max((y == 0).sum(), 1))
    return QualityModel(good, bad, tuple(fit_logistic(x, y, weight * len(y) / max(weight.sum(), 1e-9)).tolist()))


def _signals(sample: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, y, part, x0, x1 of sampled whole texts."""
    names = ["doc_id", "y", "part"]
    schema = with_columns_schema(sample, names, "x0 double, x1 double")
    out = _arrow_schema(sample.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.signals(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x[:, 0]), pa.array(x[:, 1])], schema=out)

    return sample.select(*names, "text").mapInArrow(alone(run), schema)


def score_compression_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, signal, model (which kind scored)."""
    schema = "doc_id long, score double, predicted int, signal double, model string"
    out = _arrow_schema(docs.sparkSession, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dictionary_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.signals(batch.column(1).to_pylist())
            score = shared.value.scores(x)
            said = pa.array([shared.value.kind] * len(score), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(x[:, 0]), said], schema=out)

    return docs.select("doc_id", "text").mapInArrow(alone(run), schema)


def op2_compression_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_quality_dictionaries(docs, labels, fold(F.col("doc_id"), 5) != 0)
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return score_compression_quality(docs, model).select("doc_id", held, "score", "predicted", "signal", "model")


# Language -----------------------------------------------------------------------------------


def fit_languages(docs: DataFrame, keep: Column, per_language: int = 400, dictionary_bytes: int = 262_144) -> dict[str, bytes]:
    """Raw dictionaries of the ``per_language`` texts with the smallest hashes of each language (equal texts once).

    A bound on the hash, from each language's count of distinct texts, leaves about twice as many
    rows as are wanted, so neither a language nor a common text is ever gathered whole.
    """
    spark = docs.sparkSession
    rows = docs.select("lang", "text").where(keep & F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row a language
    bounds = [(r["lang"], int(min(2 * per_language / max(r["n"], 1), 1) * (2**64 - 1)) - 2**63) for r in sizes]
    few = rows.join(F.broadcast(spark.createDataFrame(bounds, "lang string, most long")), "lang").where("h <= most")
    picked = few.select("lang", "h", spread_pieces(F.col("text"), LANGUAGE_PIECE_CHARS, PIECES).alias("pieces")).groupBy("lang", "h").agg(F.min("pieces").alias("pieces"))
    texts: dict[str, list[list[bytes]]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"])):
        if len(mine := texts.setdefault(r["lang"], [])) < per_language:
            turn = len(mine) % max(len(r["pieces"]), 1)
            mine.append([p.lower().encode() for p in r["pieces"][turn:] + r["pieces"][:turn]])
    return {lang: interleave(mine, dictionary_bytes) for lang, mine in texts.items()}


def interleave(texts: list[list[bytes]], size: int) -> bytes:
    """The first pieces of all texts, then their second ones and so on, up to ``size`` bytes: every text has its share."""
    out, room = [], size
    for k in range(max(map(len, texts), default=0)):
        for pieces in texts:
            if k < len(pieces) and len(pieces[k]) < room:
                out.append(pieces[k])
                room -= len(pieces[k]) + 1
    return b"\n".join(out)


def language_of(text: str | None, coders: list[tuple[str, object]], min_margin: float, full_margin: float) -> tuple[str, float, bool]:
    """(language, score, whether it is rejected) by summed block sizes."""
    if not text or not coders or not any(map(str.isalpha, text)):
        return UND, 0.0, True
    raw = text.lower().encode()
    blocks = [raw[a : a + BLOCK_BYTES] for a in range(0, len(raw), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in coders)
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
    return sizes[0][1], min(1.0, margin / full_margin), margin < min_margin


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01, full_margin: float = 0.2) -> DataFrame:
    """The columns of ``docs`` with lang_pred, lang_score, lang_rejected (in place of any so named).

    The score is the margin as a share of ``full_margin``, 1 at most.
    """
    spark = docs.sparkSession
    added = ["lang_pred", "lang_score", "lang_rejected"]
    names = [c for c in docs.columns if c not in added]
    schema = with_columns_schema(docs, names, "lang_pred string, lang_score double, lang_rejected boolean")
    out = _arrow_schema(spark, schema)
    shared = spark.sparkContext.broadcast(dictionaries)  # dictionary_bytes for each language
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [(lang, _compressor(d, raw=True)) for lang, d in shared.value.items()]
        for batch in batches:
            rows = [language_of(t, coders, min_margin, full_margin) for t in batch.column(text_at).to_pylist()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], schema=out)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(alone(run), schema)


def op4_compression_language_id(docs: DataFrame) -> DataFrame:
    models = fit_languages(docs.select("doc_id", "text", "lang"), fold(F.col("doc_id"), 3) != 1)
    found = predict_language(docs.select("doc_id", "text"), models)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
