"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The covariance of the distinct vectors is never built. All that is asked of it are products with a block of columns, V Q = (1/n) times the sum over
the centred vectors y of y (y' Q): one pass over the fit list, which is written as blocks of vectors once, summed by task and then by place, so
that a pass gathers ``dim * block`` numbers.

1. A few Lanczos steps from one vector give the lower end of the spectrum.
2. A Chebyshev polynomial of V, which is small on the unwanted part of the spectrum (from that end to the smallest Ritz
   value of the block) and grows fast above it, is applied to the block by its three-term recurrence: one pass a degree.
3. QR makes the block orthonormal; Rayleigh-Ritz turns it to the best vectors and values that it holds.
4. This repeats until the wanted pairs are certified: the norm of V q - e q, which bounds the distance of e to an eigenvalue, is at
   rounding level for each, or no longer falls and is below ``CERTAIN`` of the largest value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged
from .vectors import integer_rows, matrix, packed, summed, within

SCALE = 256.0
BLOCK = 16
DEGREE = 10
LANCZOS = 10
MOST_ROUNDS = 200
ROUNDING = 4e-15
CERTAIN = 1e-10
LIMIT = 1 << 31

SCHEMA = "id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def lower_end(product: Callable[[np.ndarray], np.ndarray], dim: int, steps: int = LANCZOS) -> float:
    """A value near or below the smallest eigenvalue, and not below zero, from Lanczos steps with full orthogonalisation."""
    q = np.random.default_rng(7).standard_normal(dim)
    basis, diagonal, beside = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dim)):
        w = product(basis[-1][:, None])[:, 0]
        diagonal.append(float(basis[-1] @ w))
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(abs(d) for d in diagonal):
            break
        basis.append(w / beside[-1])
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, block: int = BLOCK, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors (columns) of the symmetric positive operator ``product``."""
    width = min(dim, max(block, 2 * k))
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, width)))[0]
    low = lower_end(product, dim) if width < dim else 0.0
    before = np.inf
    for _ in range(MOST_ROUNDS):
        v = product(q)
        values, turn = np.linalg.eigh((q.T @ v + v.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, v = q @ turn, v @ turn
        off = float(np.linalg.norm(v[:, :k] - q[:, :k] * values[:k], axis=0).max())
        if off <= ROUNDING * values[0] or (off > before / 2 and off <= CERTAIN * values[0]):
            return values[:k], q[:, :k]
        before = off
        centre, half = (values[-1] + low) / 2, (values[-1] - low) / 2
        if half > 1e-12 * values[0]:
            scale = first = half / (values[0] - centre)
            last, now = q, (v - centre * q) * (scale / half)
            for _ in range(degree - 1):
                following = 1 / (2 / first - scale)
                last, now = now, (product(now) - centre * now) * (2 * following / half) - scale * following * last
                scale = following
            q = now
        else:
            q = v
        norms = np.linalg.norm(q, axis=0)
        # A column that the operator sends to nothing is drawn anew.
        q = np.where(norms > 0, q / np.where(norms > 0, norms, 1), np.random.default_rng(13).standard_normal(q.shape))
        q = np.linalg.qr(q)[0]
    raise RuntimeError(f"eigenvectors are not certified after {MOST_ROUNDS} rounds: the residual is {off / values[0]:.1e} of the largest value")


def _whiten(rows: DataFrame, fit: DataFrame, dim: int, k: int, schema: str) -> DataFrame:
    """``rows`` (id, x) of one length, whitened by the distinct vectors ``fit`` (x)."""
    fit = staged(packed(fit, dim), "blocks")
    n = fit.agg(F.sum("m")).first()[0]
    sums = summed(fit, dim, lambda x: x.sum(0, dtype=np.int64), np.int64)
    mean = np.array([int(s) / n for s in sums])
    k = min(k, dim)

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return (y.T @ (y @ q)).ravel()

        return summed(fit, dim, part).reshape(q.shape) / n

    trace = float(summed(fit, dim, lambda x: np.square(x - mean).sum(keepdims=True).ravel())[0]) / n
    values, vectors = leading_pairs(product, dim, k)
    live = values > 1e-13 * trace
    turn = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), np.nan)

    seen = turn[:, live]
    error = 0.0
    if live.any():
        middle = summed(fit, dim, lambda x: ((x - mean) @ seen).sum(0)) / n

        def spread(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ seen - middle
            return (w.T @ w).ravel()

        error = float(np.abs(summed(fit, dim, spread).reshape(len(middle), -1) / n - np.eye(len(middle))).max())
    explained = np.where(live, values / trace, 0.0) if trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [int(s) for s in sums]
        for b in batches:
            m, x = b.num_rows, matrix(b.column(1), dim)
            top = int(np.abs(x).max(initial=0))
            if dim * (n * top + max(map(abs, exact))) ** 2 < 1 << 63:
                deviation = pa.array(np.square(n * x - sums).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(sum((n * a - s) ** 2 for a, s in zip(row, exact, strict=True))) for row in x.tolist()], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), k))
            w = (x - mean) @ turn
            columns = [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(each)]
            columns += [pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, k: int = 4, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row and component up to ``k``: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Components x of a vector are floor(scale * c). The fit list holds each distinct vector once, n of them with sums S by dimension;
    covariances are over it. ``whitened`` is x - S / n on the component's unit vector, over the root of its eigenvalue e;
    ``explained`` is e over the trace; ``deviation`` the exact sum of (n x - S)^2, a decimal; ``identity_error`` the largest
    absolute entry of the covariance of ``whitened``, minus the identity.

    Vectors that are null or hold null or non-finite components take no part. Rows with a null or repeated id do, each for itself; repeated
    vectors are one in the fit list. Vectors of each length are whitened on their own, and have as many components as their
    length where that is less than k. Where e is zero (one distinct vector, or fewer than k dimensions in which they differ),
    ``whitened`` is null and ``explained`` 0, and the component takes no part in ``identity_error``. A scaled component of
    2^31 or more raises. An empty table gives no rows. Other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = staged(integer_rows(vectors, vec_col, scale, {"id": id_col}), "integers")
    fit = staged(bounded_batches(rows).select("x", "dim").distinct(), "fit")
    schema = SCHEMA.format(kind=kind)
    out = rows.sparkSession.createDataFrame([], schema)
    for dim in within(fit, LIMIT):
        if dim:
            out = out.unionByName(_whiten(rows.filter(F.col("dim") == dim), fit.filter(F.col("dim") == dim), dim, k, schema))
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; null beyond its range, which 100,000 vectors of components up to 4 don't reach."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").try_cast("long"))
