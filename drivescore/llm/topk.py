"""Exact top-k inner-product search by tiled matrix products.

Candidate vectors stay where they are. Query vectors go to them in blocks of at most ``QUERY_BYTES``, which are broadcast, one
block in a round, and forgotten after it. A tile is a batch of candidates with a part of the block: its scores are one matrix
product, from which each query's best k are selected at once and merged with those of the task's tiles before.
The per-query lists of the tasks then merge in a tree, ``fan`` lists at
a time, so no step holds more than ``fan * k`` entries of a query. Only these lists are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged

QUERY_BYTES = 32 << 20
TILE = 1 << 21  # scores that a tile holds
EXACT = float(1 << 53)


class Best:
    """The best k of the candidates seen so far for each query of one length; larger score first, then smaller id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.rows, self.v, self.k = ids, rows, v, k
        self.reach = float(np.abs(v).max(initial=0)) * max(1, v.shape[1])
        self.floats = v.astype(float)
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        self.entries: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)

    def add(self, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(c_ids)))
        # Doubles hold all integers below 2**53, so that the fast product is exact; else integers multiply.
        exact = self.reach * float(np.abs(c).max(initial=0)) < EXACT
        other = c.astype(float).T if exact else c.T
        own = {int(r): at for at, r in enumerate(c_rows)}
        for begin in range(0, len(self.ids), step):
            part = slice(begin, begin + step)
            scores = np.rint(self.floats[part] @ other).astype(np.int64) if exact else self.v[part] @ other
            for q in np.flatnonzero((scores.max(1) >= self.least[part]) | [len(e) < self.k for e in self.entries[part]]):
                at, s = begin + int(q), scores[q]
                mine = own.get(int(self.rows[at]))
                keep = np.flatnonzero(s >= self.least[at]) if len(self.entries[at]) >= self.k else np.arange(len(s))
                keep = keep[keep != mine] if mine is not None else keep
                if len(keep) > self.k:
                    keep = keep[s[keep] >= np.partition(s[keep], len(keep) - self.k)[len(keep) - self.k]]
                found = self.entries[at] + list(zip((-s[keep]).tolist(), c_ids[keep].tolist(), strict=True))
                self.entries[at] = sorted(found)[: self.k]
                if len(self.entries[at]) == self.k:
                    self.least[at] = -self.entries[at][-1][0]


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v, dim): floor(scale * x) of each component; only rows with an id and a whole finite vector."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return rows.select("id", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"), F.size("x").alias("dim"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", fan: int = 16) -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score: the k best candidates of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own,
    of the query's length. Score is the inner product of the components
    floor(scale * x); ties go to the smaller id; all candidates are listed if there are fewer than k.
    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null
    id. A row that repeats an id is a candidate, and a query, of its own. An empty table gives no rows. Other columns are ignored.
    """
    rows = staged(integer_vectors(vectors, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asking = rows.filter(F.col("id") % every == 0)
    n, longest = asking.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    blocks = max(1, -(-n * 8 * (longest + 2) // QUERY_BYTES))
    rounds = []
    for block in range(blocks):
        own = asking.filter(F.pmod(F.xxhash64("row", F.lit("query")), F.lit(blocks)) == block).orderBy("row").toArrow()  # about QUERY_BYTES
        dims = own.column("dim").to_numpy()
        queries = {int(d): tuple((m := own.filter(pa.array(dims == d))).column(c).to_numpy() for c in ("id", "row")) + (matrix(m.column("v"), int(d)),) for d in np.unique(dims)}
        shared = rows.sparkSession.sparkContext.broadcast(queries)

        def tiles(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: Best(*q, k) for d, q in shared.value.items()}
            for b in batches:
                dims = b.column(3).to_numpy(zero_copy_only=False)
                for d in np.intersect1d(np.unique(dims), list(best)):
                    part = b.filter(pa.array(dims == d))
                    best[int(d)].add(part.column(0).to_numpy(), part.column(2).to_numpy(), matrix(part.column(1), int(d)))
            task = TaskContext.get().partitionId()
            for x in best.values():
                some = [at for at, e in enumerate(x.entries) if e]
                top = pa.array([[{"s": s, "c": c} for s, c in x.entries[at]] for at in some], pa.list_(pa.struct([("s", pa.int64()), ("c", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(x.rows[some]), pa.array(x.ids[some]), pa.array([task] * len(some), pa.int64()), top], names=["row", "query_id", "list", "top"])

        found = bounded_batches(rows.select("id", "v", "row", "dim")).mapInArrow(tiles, "row long, query_id long, list long, top array<struct<s:long,c:long>>")
        # Once a round's lists are written nothing asks for its block again: the driver and the executors let it go.
        rounds.append(staged(found, "lists"))
        shared.destroy()
    merged = reduce(DataFrame.unionByName, rounds)
    width = (merged.agg(F.max("list")).first()[0] or 0) + 1
    while True:
        width = -(-width // fan)
        merged = merged.withColumn("list", F.expr(f"list div {fan}")).groupBy("row", "query_id", "list").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if width <= 1:
            break
    return merged.select("query_id", F.posexplode("top").alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.c").alias("vec_id"), (-F.col("e.s")).alias("score"))


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
e as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from v),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(sum(q.x * c.x) as bigint) as score
  from e q join e c on q.i = c.i and q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
