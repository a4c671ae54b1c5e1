"""Embedding whitening: exact integer scatter, floats only for the last step.

Entries become integers x = floor(scale * c) + offset. Each task subtracts the shift (the offset),
so y = x - shift is small, and adds up n, sum(y) and sum(y y^T) as whole numbers of any size: y is
split into digits of 20 bits, digit products of at most 4,096 rows are exact in floating-point
matrix products, and the digits' products are put together as Python integers. Tasks emit their
sums in limbs of 32 bits, Spark adds limbs as longs, and the driver gets d * (d + 3) / 2 numbers,
however many rows there are. From these M = n * YtY - S St is formed exactly; only M / n^2, the
covariance, is turned into floats and decomposed by eigh.

A second scan projects: (n * y - S) is exact, its float over n is projected on the unit
eigenvectors and divided by the square root of the eigenvalue.

Defined cases: null vectors and vectors with a null or non-finite entry are left out; of vectors of
several lengths the commonest length counts (ties: the longest), the others are left out; products
beyond 64 bits saturate as Spark's floor does. Components without variance (an eigenvalue under
``ZERO`` times the largest) are left out, so one row, equal rows or an empty table give no rows.
Repeated and null vec_ids stay rows of their own; extra columns are ignored. ``deviation`` is exact;
where it goes beyond 64 bits the long is null and ``deviation_digits`` has it. Eigenvectors have
their largest entry positive. ``identity_error`` is taken from the exact covariance and the floats
that project.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, drop_table, persist_table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows and bits of a digit of one matrix product: 2^20 * 2^20 * 2^12 < 2^53, so every sum in it is exact.
ROWS, BITS = 4096, 20
#: Eigenvalues under this share of the largest are rounding, not variance.
ZERO = 1e-12
_LIMB = 32
_SUMS = "dim int, i int, j int, limb int, value long"


@dataclass
class Scatter:
    """Exact sums over ``n`` shifted integer vectors: ``total`` (d) and ``cross`` (d x d), Python integers."""

    n: int
    total: np.ndarray
    cross: np.ndarray

    def covariance_numerator(self) -> np.ndarray:
        """n * YtY - S St, which is n^2 times the covariance."""
        return self.n * self.cross - np.outer(self.total, self.total)


@dataclass
class Whitening:
    """What projecting needs: exact counts and sums, the largest components first."""

    n: int
    total: np.ndarray  # of shifted vectors, Python integers
    vectors: np.ndarray  # d x k, unit columns
    values: np.ndarray  # k eigenvalues
    explained: np.ndarray  # k shares of the trace
    identity_error: float
    scale: int = SCALE
    offset: int = OFFSET


def _shifted(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """x - offset as int64; beyond 64 bits it saturates."""
    y = np.floor(values * float(scale))
    top = float(2**62)
    out = np.clip(y, -top, top).astype(np.int64)
    big = np.abs(y) >= top
    if big.any():
        out[big] = np.where(y[big] > 0, 2**63 - 1 - offset, -(2**63))
    return out


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Floats of ``BITS``-bit digits, lowest first; the last one carries the sign."""
    out = []
    while len(y) and max(-int(y.min()), int(y.max())) >= 1 << BITS:
        out.append((y & ((1 << BITS) - 1)).astype(np.float64))
        y = y >> BITS
    return [*out, y.astype(np.float64)]


def scatter(y: np.ndarray) -> Scatter:
    """Exact sums of the rows of an int64 matrix."""
    d = y.shape[1]
    found = Scatter(len(y), np.zeros(d, object), np.zeros((d, d), object))
    for at in range(0, len(y), ROWS):
        digits = _digits(y[at : at + ROWS])
        for a, left in enumerate(digits):
            found.total += left.sum(0).astype(np.int64).astype(object) << (BITS * a)
            for b, right in enumerate(digits):
                found.cross += (left.T @ right).astype(np.int64).astype(object) << (BITS * (a + b))
    return found


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) of the usable vectors of each length."""
    if not len(column):
        return
    lens = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()  # without what stands behind null lists
    number = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(np.maximum(lens, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(number))])
    starts = ends - np.maximum(lens, 0)
    usable = (lens > 0) & (bad[ends] == bad[starts])
    for d in np.unique(lens[usable]):
        rows = np.flatnonzero(usable & (lens == d))
        yield rows, number[starts[rows][:, None] + np.arange(d)]


def _limbs(value: int) -> list[int]:
    """Signed top limb, unsigned lower ones."""
    out = []
    while not -(1 << (_LIMB - 1)) <= value < 1 << (_LIMB - 1):
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


def sum_scatter(embeddings: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> Scatter | None:
    """Exact sums over the usable vectors of the commonest length; None where there is none."""
    spark = embeddings.sparkSession
    out = _arrow_schema(spark, _SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Scatter] = {}
        for batch in batches:
            for rows, values in _vectors(batch.column(0)):
                new, d = scatter(_shifted(values, scale, offset)), values.shape[1]
                old = sums.setdefault(d, Scatter(0, np.zeros(d, object), np.zeros((d, d), object)))
                sums[d] = Scatter(old.n + new.n, old.total + new.total, old.cross + new.cross)
        for d, s in sums.items():  # j = -1: sums, i = j = -1: rows
            cells = [(-1, -1, s.n), *((i, -1, s.total[i]) for i in range(d)), *((i, j, s.cross[i, j]) for i in range(d) for j in range(i + 1))]
            rows = [(d, i, j, k, limb) for i, j, v in cells for k, limb in enumerate(_limbs(int(v)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    parts = embeddings.select(F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, _SUMS)
    sums = persist_table(parts.groupBy("dim", "i", "j", "limb").agg(F.sum("value").alias("value")), "scatter")  # some KB; the vectors are read once for it
    counts = sums.where("i = -1").collect()  # a row or two for each vector length that occurs
    size: dict[int, int] = {}
    for r in counts:
        size[r["dim"]] = size.get(r["dim"], 0) + (r["value"] << (_LIMB * r["limb"]))
    if not size:
        drop_table(sums)
        return None
    d = max(size, key=lambda k: (size[k], k))
    found = Scatter(size[d], np.zeros(d, object), np.zeros((d, d), object))
    for r in sums.where((F.col("dim") == d) & (F.col("i") >= 0)).collect():  # bounded by the dimension alone
        v = r["value"] << (_LIMB * r["limb"])
        if r["j"] < 0:
            found.total[r["i"]] += v
        else:
            found.cross[r["i"], r["j"]] += v
            if r["i"] != r["j"]:
                found.cross[r["j"], r["i"]] += v
    drop_table(sums)
    return found


def whitening(found: Scatter, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """Decompose the exact covariance; at most ``components`` components, those without variance left out."""
    exact = found.covariance_numerator()
    square = found.n * found.n
    cov = np.array([[v / square for v in row] for row in exact.tolist()], np.float64)  # Python rounds a quotient of integers once
    trace = sum(exact[i, i] for i in range(len(exact))) / square
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    keep = np.flatnonzero(values > max(values[0], 0.0) * ZERO)[:components]
    values, vectors = values[keep], vectors[:, keep]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    by = vectors / np.sqrt(values)
    error = float(np.abs(by.T @ cov @ by - np.eye(len(keep))).max()) if len(keep) else 0.0
    return Whitening(found.n, found.total, vectors, values, values / trace if len(keep) else values, error, scale, offset)


def fit_whitening(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """Two jobs over ``embeddings`` (embedding): exact sums, then eigh of a d x d matrix on the driver."""
    found = sum_scatter(embeddings, scale, offset)
    return whitening(found, components, scale, offset) if found else None


def _deviations(y: np.ndarray, n: int, total: np.ndarray) -> list[int]:
    """sum over dimensions of (n * y - S)^2 for each row, exactly: n^2 yy - 2 n yS + SS."""
    top = max(-int(y.min()), int(y.max()), 1)
    most = max(abs(int(t)) for t in total)
    wide = y.shape[1] * top * max(top, most) >= 2**63
    z, s = (y.astype(object), total) if wide else (y, total.astype(np.int64))
    squares, products, own = (z * z).sum(1).tolist(), (z * s).sum(1).tolist(), sum(int(t) ** 2 for t in total)
    return [n * n * q - 2 * n * p + own for q, p in zip(squares, products)]


def _centred(y: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n: the numerator is exact, its float is divided once."""
    top = max(-int(y.min()), int(y.max()), 1)
    most = max(abs(int(t)) for t in total)
    if n * top + most < 2**63:
        return (n * y - total.astype(np.int64)) / np.float64(n)
    return np.array((n * y.astype(object) - total) / n, np.float64)


def apply_whitening(embeddings: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits: a row for each usable vector and component."""
    spark = embeddings.sparkSession
    key = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    out = _arrow_schema(spark, schema)
    held = spark.sparkContext.broadcast(model)  # d * (k + 1) numbers
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        by = m.vectors / np.sqrt(m.values)
        for batch in batches:
            for rows, values in _vectors(batch.column(1)):
                if values.shape[1] != len(m.total):
                    continue
                y = _shifted(values, m.scale, m.offset)
                deviations = _deviations(y, m.n, m.total)
                white = _centred(y, m.n, m.total) @ by
                place, r = pa.array(np.repeat(np.arange(len(rows)), k)), len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)).take(place),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                        pa.array(np.full(r * k, m.n)),
                        pa.array([v if v < 2**63 else None for v in deviations], pa.int64()).take(place),
                        pa.array(white.ravel()),
                        pa.array(np.tile(m.explained, r)),
                        pa.array(np.full(r * k, m.identity_error)),
                        pa.array([str(v) for v in deviations], pa.string()).take(place),
                    ],
                    schema=out,
                )

    return embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)


def op11_embedding_whitening(embeddings: DataFrame, **options) -> DataFrame:
    return apply_whitening(embeddings, fit_whitening(embeddings, **options))
