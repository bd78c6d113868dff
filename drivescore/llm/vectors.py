"""Integer vectors, and sums over them by task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_rows(df: DataFrame, vec_col: str, scale: float, keep: dict[str, str]) -> DataFrame:
    """(x, dim and the columns ``keep``: new name by name): x is floor(scale * c) of each component c of a vector.

    Only rows whose vector is whole and finite.
    """
    rows = df.filter(F.col(vec_col).isNotNull()).select(*[F.col(c).alias(n) for n, c in keep.items()], F.transform(vec_col, lambda c: c.cast("double")).alias("c"))
    rows = rows.filter(F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return rows.select(*keep, F.transform("c", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("x"), F.size("c").alias("dim"))


def within(rows: DataFrame, limit: int) -> list[int]:
    """The lengths of the vectors ``x``; raises if a component reaches ``limit``, since results would leave the range of long."""
    largest = F.max(F.coalesce(F.array_max(F.transform("x", lambda c: F.greatest(c, -c))), F.lit(0)))
    found = rows.groupBy("dim").agg(largest.alias("m")).orderBy("dim").collect()
    if any(r.m >= limit or r.m < 0 for r in found):
        raise ValueError(f"a vector holds a component beyond {limit} after scaling")
    return [r.dim for r in found]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """The vectors ``x``, whose components are below 2^31, as blocks: (m, block) with m vectors of 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block = matrix(b.column(0), dim).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), pa.array([block], pa.binary())], names=["m", "block"])

    return rows.select("x").mapInArrow(run, "m int, block binary")


def _matrices(b: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    if b.num_columns == 1:
        yield matrix(b.column(0), dim)
        return
    for m, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        yield np.frombuffer(block.as_buffer(), np.int32).reshape(m, dim)


def summed(rows: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
    """Sum of ``part`` (a flat array of a fixed length) over the vectors ``x``, or ``packed`` blocks of them: by task first, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in _matrices(b, dim) if b.num_rows else ():
                now = part(x)
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.astype(kind))], names=["at", "v"])

    columns = ["m", "block"] if "block" in rows.columns else ["x"]
    sums = rows.select(*columns).mapInArrow(run, f"at int, v {'double' if kind is np.float64 else 'long'}").groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at")
    return sums.column("v").to_numpy()
