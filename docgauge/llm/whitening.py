"""Whitening of embeddings on their leading principal components.

Entries become whole numbers, so that equal vectors are found exactly and sums are exact.
The components are those of the different vectors (the fit list), by Chebyshev-filtered
subspace iteration:

* A pass over the fit list, dealt over its files, gives V Q for a block Q of some columns,
  where V is the covariance; each task sums C'(C Q) over its centred rows C, Spark adds the
  sums of the tasks, and the driver holds matrices of dimensions by columns only.
* Rayleigh-Ritz: eigenvectors of Q'VQ turn Q and VQ to Ritz vectors, for which the residual
  |V u - e u| is known without a further pass.
* Until the residuals certify the leading vectors, a Chebyshev polynomial of V is applied,
  pass by pass: the unwanted spectrum, from 0 to the least Ritz value of the block, is mapped
  to [-1, 1] and damped, what lies above grows.  QR makes the block orthonormal again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import stored

SCALE = 256
COMPONENTS = 4
#: Columns beyond the wanted ones: more damp faster in each pass.
BESIDE = 28
#: Residuals of certified vectors, as a part of the first eigenvalue.
TOLERANCE = 2e-13
#: Where rounding keeps residuals above TOLERANCE, this will do once they fall no more.
ROUNDED = 1e-10
#: Passes between two orthonormalisations at most.
DEGREE = 14
#: A block is orthonormalised before its columns differ in size by more than this.
GROWTH = 1e7
ROUNDS = 60
#: Variances up to this part of the first count as none.
RANK = 1e-12
_ROWS = 4096


@dataclass
class Whitening:
    """Components as columns, their variances, and what was summed exactly over the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    residuals: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(embedding: Column) -> Column:
    """floor(SCALE * entry) of every entry; null for a null or empty vector and for one with entries that are null, not finite or beyond a long."""
    scaled = F.transform(embedding, lambda c: c.cast("double") * SCALE)
    bad = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**63))
    return F.when((F.size(embedding) > 0) & ~bad, F.transform(scaled, lambda c: F.floor(c)))  # noqa: PLW0108


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, len(b), _ROWS):
            yield b.slice(low, _ROWS)


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and the exact sum of each dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dim, "int64"), np.zeros(dim, "int64"), 0
        for b in _parts(batches):  # halves of 32 bits can't run over
            x = _matrix(b.column("x"), dim)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low), pa.array(np.full(dim, n))], ["i", "high", "low", "n"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = fit.mapInArrow(summed, "i long, high long, low long, n long").groupBy("i").agg(wide("high"), wide("low"), wide("n")).collect()
    sums = [0] * dim
    for r in found:
        sums[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return (int(found[0]["n"]) if found else 0), sums


def _applied(fit: DataFrame, n: int, mean: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """V times block in one pass, and the trace of V; a row for each task and entry of the product is shuffled."""
    known = fit.sparkSession.sparkContext.broadcast((mean, block))
    dim, width = block.shape

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, q = known.value
        total = np.zeros((dim, width + 1))
        for b in _parts(batches):
            c = _matrix(b.column("x"), dim) - centre
            total[:, :width] += c.T @ (c @ q)
            total[:, width] += (c * c).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(dim * (width + 1))
    for r in fit.mapInArrow(passed, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    known.destroy()
    out = out.reshape(dim, width + 1)
    out /= n
    return out[:, :width], float(out[:, width].sum())


def _degree(top: float, cut: float) -> int:
    """Passes after which the first column has grown by GROWTH against the damped part."""
    rate = math.acosh(max(2 * top / cut - 1, 1 + 1e-6)) if cut > 0 else math.inf
    return int(max(1, min(DEGREE, math.log(2 * GROWTH) / rate)))


def fit_components(fit: DataFrame, dim: int, components: int = COMPONENTS, seed: int = 1) -> Whitening | None:
    """The leading components of the different vectors x; None without rows.

    Components without variance are left out.  Raises an error if ROUNDS don't certify them.
    """
    n, sums = _sums(fit, dim)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    width = min(dim, components + BESIDE)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0] if width < dim else np.eye(dim)
    passes, before = 0, math.inf
    for _ in range(ROUNDS):
        image, total = _applied(fit, n, mean, block)
        passes += 1
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        wanted = [k for k in range(min(components, width)) if values[k] > RANK * max(values[0], 0.0) and values[0] > 0]
        worst = np.linalg.norm(image - block * values, axis=0)[: len(wanted)]
        reached = worst.max(initial=0.0) / max(values[0], 1e-300)
        if not wanted or reached <= TOLERANCE or width == dim or (reached <= ROUNDED and reached > before / 2):
            return Whitening(n, sums, block[:, : len(wanted)], values[: len(wanted)], total, worst, passes)
        before = reached
        # Scaled three-term recurrence; the first product, V times the Ritz vectors, is there already.
        half = max(values[-1], RANK * values[0]) / 2
        first = sigma = half / (values[0] - half)
        last, now = block, (image - half * block) * (sigma / half)
        for _ in range(_degree(values[0], 2 * half) - 1):
            step = 1 / (2 / first - sigma)
            product, _ = _applied(fit, n, mean, now)
            passes += 1
            last, now = now, (product - half * now) * (2 * step / half) - last * (sigma * step)
            sigma = step
        block = np.linalg.qr(now)[0]
    raise ArithmeticError(f"components are not certified after {ROUNDS} rounds: residuals {worst}")


def _exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum of (n x - S)^2 over the dimensions of each row, in whole numbers of any size."""
    most, span, dim = int(np.abs(x).max(initial=0)), sum(map(abs, sums)), x.shape[1]
    if most * most * dim < 2**62 and most * span < 2**62 and most < 2**62:
        square, cross = (x * x).sum(1).tolist(), (x @ np.array(sums, "int64")).tolist()
    else:
        square = [sum(v * v for v in row) for row in x.tolist()]
        cross = [sum(v * s for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    own = sum(s * s for s in sums)
    return [n * n * a - 2 * n * b + own for a, b in zip(square, cross, strict=True)]


def whitened(vectors: DataFrame, components: int = COMPONENTS, seed: int = 1) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable vector and component.

    vectors: vec_id and embedding.  Null and empty vectors and those with entries that are
    null or not finite are dropped; so are vectors whose length isn't the commonest one (ties:
    the greater length).  Components without variance are left out, so that a single vector or
    an empty table gives no rows.  Components of equal variance are any basis of their space.
    Vectors that repeat count once for the fit and are all returned, with null vec_ids as
    they are; other columns are ignored.  deviation is decimal(38,0), exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_vectors(F.col("embedding")).alias("x")).filter("x IS NOT NULL")
    common = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    rows = rows.filter(F.size("x") == dim)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    made = fit_components(fit, dim, components, seed)
    if made is None or not len(made.variances):
        return spark.createDataFrame([], schema)
    known = spark.sparkContext.broadcast((made, made.mean, made.components / np.sqrt(made.variances)))
    width = len(made.variances)
    names = [f"w{k}" for k in range(width)]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, mean, turn = known.value
        for b in _parts(batches):
            w = (_matrix(b.column("x"), dim) - mean) @ turn
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], names)

    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    covariances = fit.mapInArrow(projected, ", ".join(f"{c} double" for c in names)).agg(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(covariances, pairs, strict=True))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, mean, turn = known.value
        explained = fitted.variances / fitted.total
        for b in _parts(batches):
            x = _matrix(b.column("x"), dim)
            deviation = pa.array(_exact_deviation(x, fitted.n, fitted.sums), pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), width))
            count = len(x) * width
            columns = [
                b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, width + 1, dtype="int32"), len(x))), pa.array(np.full(count, fitted.n)), deviation.take(each),
                pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(placed, schema)
