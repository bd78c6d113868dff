"""Helpers shared by the training-data operators: staged tables, two-level running sums, components.

Nothing here collects rows: every helper maps DataFrames to DataFrames, and the only scalars
that reach the driver are row counts.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BATCH_BYTES = 4 << 20
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN_DIR.setdefault("dir", tempfile.mkdtemp(prefix="spark-staged-"))


def staged(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet, in a folder for each value of ``by``, and read it back.

    Cuts the lineage in a way that survives lost executors: the files are complete and shared
    before anything reads them, and each call writes a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of a few longs a row, to be broadcast if it has no more than ``most`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def bounded_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """``df``, after its session's Arrow batches were bounded to ``most`` bytes, so that a Python worker holds few texts at once.

    A batch has one row at least, so a longer text is still whole. A smaller bound of the session stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(key, "67108864")).rstrip("b")) > most:
        conf.set(key, str(most))
    return df


def release(*caches: dict) -> None:
    """Empty a finished task's caches and give the memory back, since the worker lives on for other tasks."""
    for c in caches:
        c.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bucket_count(rows: int, per_bucket: int = 4096, least: int = 64, most: int = 65536) -> int:
    """Buckets over which a hot key is dealt, so that each holds a few thousand rows of it."""
    return max(least, min(most, -(-rows // per_bucket)))


def before(value: Column, keys: Sequence[str], order: Iterable[Column]) -> Column:
    """Sum of ``value`` over the rows that come before this one within ``keys``; 0 for the first."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of each node in ``edges`` (columns a, b of a numeric type).

    Alternates large-star and small-star steps until the edge set stops changing, staging each
    round. Rows of the result: node, root. Nodes without an edge do not appear. A hub's minimum is a partial aggregate
    that is joined back as one row: a join whose other side Spark splits where it is skewed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        if not large:
            both = both.filter("v < u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                low.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return out.filter("a <> b").distinct()

    def summary(e: DataFrame) -> tuple:
        row = e.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))
        ).first()
        return tuple(row)

    current = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = summary(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        current = staged(star(star(current, True), False), "edges")
        now = summary(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
