"""Compression of vectors to codes of their parts' nearest codebook entries, found by equal-average search.

A vector is cut into equal parts, each position of which has a codebook that Lloyd's rounds fit to the parts of all vectors. The nearest
entry is searched along the entries' component sums: by Cauchy and Schwarz, (sum of part - sum of entry)^2 is at most
the part's width times their squared distance. Entries are sorted by sum; from a part's own sum the search goes outward
on both sides, and a side ends when the squared gap of sums over the width is strictly more than the best distance, so that
entries of equal distance are all seen and the lowest index wins. Parts of like sums go in tiles, whose distances to the next few entries
are one matrix product; each part ends on its own.

A round is one pass over the vectors: tasks sum the parts of each entry, sums meet by place, and the driver holds the codebooks alone
(``parts * entries`` rows of a part's width).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, staged
from .vectors import integer_rows, matrix, summed, within

SCALE = 1024.0
PARTS, ENTRIES, ROUNDS = 4, 256, 4
TILE, STEP = 512, 32
EXACT = 1 << 53
LIMIT = 1 << 30


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: doubles where they hold every sum, which multiply faster."""
    top = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * top) ** 2 < EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry of ``book``, the lowest of equal ones, and the squared distance."""
    many, width = book.shape
    order = np.argsort(book.sum(1), kind="stable")
    entries, sums, own = book[order], book.sum(1)[order], x.sum(1)
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    by_sum = np.argsort(own, kind="stable")
    for begin in range(0, len(x), TILE):
        tile = by_sum[begin : begin + TILE]
        v, s = x[tile], own[tile]
        best, at = np.full(len(tile), (1 << 62) // max(1, width)), np.full(len(tile), many)

        def visit(rows: np.ndarray, lo: int, hi: int, v=v, best=best, at=at) -> None:
            names = np.sort(order[lo:hi])
            d = squared_distances(v[rows], book[names])
            first = d.argmin(1)
            least, name = d[np.arange(len(rows)), first], names[first]
            better = (least < best[rows]) | ((least == best[rows]) & (name < at[rows]))
            best[rows[better]], at[rows[better]] = least[better], name[better]

        lo = hi = int(np.searchsorted(sums, s[len(s) // 2]))
        left = right = np.arange(len(tile))
        while (lo > 0 and len(left)) or (hi < many and len(right)):
            if hi < many and len(right):
                gap = np.maximum(sums[hi] - s[right], 0)
                right = right[gap * gap <= width * best[right]]
                if len(right):
                    visit(right, hi, min(many, hi + STEP))
                hi += STEP
            if lo > 0 and len(left):
                gap = np.maximum(s[left] - sums[lo - 1], 0)
                left = left[gap * gap <= width * best[left]]
                if len(left):
                    visit(left, max(0, lo - STEP), lo)
                lo -= STEP
        index[tile], distance[tile] = at, best
    return index, distance


def cut(x: np.ndarray, width: int) -> np.ndarray:
    """Rows to (part, row, place): zeros fill the last part."""
    full = np.zeros((len(x), PARTS * width), np.int64)
    full[:, : x.shape[1]] = x
    return full.reshape(len(x), PARTS, width).transpose(1, 0, 2)


def fit_codebooks(rows: DataFrame, dim: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, place) of the vectors ``rows`` (id, x): the first entries are the parts of the smallest ids."""
    width = -(-dim // PARTS)
    first = rows.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).toArrow()
    books = cut(matrix(first.column("x").combine_chunks(), dim), width)
    many = books.shape[1]
    for _ in range(rounds):

        def gather(x: np.ndarray, books=books) -> np.ndarray:
            total = np.zeros((PARTS, many, 1 + width), np.int64)
            for p, part in enumerate(cut(x, width)):
                index = nearest(part, books[p])[0]
                total[p, :, 0] = np.bincount(index, minlength=many)
                np.add.at(total[p, :, 1:], index, part)
            return total.ravel()

        total = summed(rows, dim, gather, np.int64).reshape(PARTS, many, 1 + width)
        used = total[:, :, :1] > 0
        books = np.where(used, total[:, :, 1:] // np.where(used, total[:, :, :1], 1), books)
    return books


def _coded(rows: DataFrame, dim: int, rounds: int, entries: int, schema: T.StructType) -> DataFrame:
    books = fit_codebooks(rows, dim, rounds, entries)
    seal = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [nearest(part, books[p]) for p, part in enumerate(cut(matrix(b.column(2), dim), books.shape[2]))]
            code = ["".join(f"{i:02x}" for i in row) for row in zip(*(index.tolist() for index, _ in found), strict=True)]
            columns = [b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(sum(d for _, d in found)), pa.array([seal] * b.num_rows, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("id", "label", "x").mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = SCALE, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """One row per vector: id, code, error, label_error, codebooks_sha256.

    Components are floor(scale * c); vectors are cut into 4 equal consecutive parts (zeros fill the last one where the length is no
    multiple of 4). A position's codebook starts as the parts of the ``entries`` smallest ids (null last, then by vector; as many as there are) and
    takes ``rounds`` rounds of assignment and componentwise floor(sum / count); unused entries stay. ``code`` has two hexadecimal digits
    a part, ``error`` is the squared distance of all parts, ``label_error`` its sum over the rows of equal labels, null being a label
    like others, and ``codebooks_sha256`` names the final entries.

    Vectors that are null or hold null or non-finite components take no part. Repeated and null ids give a row each. Vectors of each length have
    codebooks of their own. A scaled component of 2^30 over a part's width or more raises. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = staged(bounded_batches(integer_rows(vectors, vec_col, scale, {"id": id_col, "label": label_col})), "integers")
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType)]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    lengths = within(rows, LIMIT)
    out = rows.sparkSession.createDataFrame([], schema)
    for dim in lengths:
        own = rows.filter(F.col("dim") == dim)
        within(own, LIMIT // max(1, -(-dim // PARTS)))
        out = out.unionByName(_coded(own, dim, rounds, entries, schema))
    coded = staged(out, "codes")
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    # Not broadcast by force: Spark does where the labels are few, else it splits a label of very many rows.
    named = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return named.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} as materialized (
  select vec_id, label, p.k, any_value(p.x) as x, min(cast(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) as bigint) * 256 + b.e) as m
  from parts p join b{r} b on p.k = b.k group by 1, 2, 3)""")
        if r < ROUNDS:
            steps.append(f"""n{r} as (
  select k, e, list(y order by i) as x from (
    select k, m % 256 as e, i, floor(sum(x[i]) / count(*)) as y from a{r}, (select unnest(range(1, (select max(len(x)) from parts) + 1)) as i) group by 1, 2, 3) group by 1, 2),
b{r + 1} as materialized (select b.k, b.e, coalesce(n.x, b.x) as x from b{r} b left join n{r} n on n.k = b.k and n.e = b.e)""")
    return f"""
with v as materialized (
  select vec_id, label, list_transform(embedding, lambda c: floor(1024 * cast(c as double))) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(cast(c as double)))) = 0),
parts as materialized (select vec_id, label, k, x[k * (len(x) // 4) + 1 : (k + 1) * (len(x) // 4)] as x from v, (select unnest(range(4)) as k)),
b0 as materialized (select k, e, x from (select k, x, row_number() over (partition by k order by vec_id) - 1 as e from parts) where e < 256),
{", ".join(steps)},
rows as (
  select vec_id, label, string_agg(printf('%02x', m % 256), '' order by k) as code, cast(sum(m // 256) as bigint) as error from a{ROUNDS} group by 1, 2),
seal as (select sha256(string_agg(s, ',' order by k, e)) as codebooks_sha256 from (select k, e, array_to_string(list_transform(x, lambda c: cast(cast(c as bigint) as varchar)), ',') as s from b{ROUNDS}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from rows, seal
"""


ORACLE_SQL = _sql()


def query(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
