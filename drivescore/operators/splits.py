"""Balanced cross-validation splits by hash ranks: the same under any partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from drivescore.functions.uniform import pair_words
from drivescore.functions.variants import hash_uniform
from drivescore.operators.boosting import spread
from drivescore.sources.tables import written


LEAST_BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 64, 65_536, 4096
SLICE = 2048


def same_keys(left: list[str], right: list[str]) -> Column:
    """Equality of columns one by one, where NULL equals NULL."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def bucket_number(rows: DataFrame, keys: list[str]) -> int:
    """So many buckets of a uniform number that the largest key has a few thousand rows in each."""
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-most // BUCKET_ROWS)))


def numbered(rows: DataFrame, keys: list[str], u: str, order: list[str], name: str, buckets: int) -> DataFrame:
    """Add the rank (from 1) of each row within the keys, by the uniform number ``u`` and then by ``order``.

    Rows are ranked within buckets of u, whose sizes are summed before: no window holds more of a key than a bucket, or its
    ``buckets`` sizes. ``rows`` are read twice, so they should be cheap to read.
    """
    dealt = rows.withColumn("_b", F.floor(F.col(u) * buckets).cast("int"))
    named = [f"_k_{k}" for k in keys]
    over = W.partitionBy(*named).orderBy("_kb").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col("_b").alias("_kb")).agg(F.count("*").alias("_many"))
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_many").over(over), F.lit(0))).drop("_many")
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(u, *order)))
    return own.join(sizes, same_keys([*keys, "_b"], [*named, "_kb"])).withColumn(name, F.col("_own") + F.col("_base")).select(*rows.columns, name)


def among_smallest(rows: DataFrame, keys: list[str], u: str, order: list[str], k: str | float, name: str, buckets: int) -> DataFrame:
    """Add whether a row is among the ``k`` smallest of its keys, by the uniform number ``u`` and then by ``order``. ``k`` is one for all rows of a key:
    a column, or a share of the key's rows, which is rounded up.

    Counts by bucket of u tell the bucket in which the k-th row lies: rows of lower buckets are in, those of higher ones are not, and only that
    bucket is ranked. ``rows`` are read three times, so they should be cheap to read; but for that bucket's, they move only to meet their
    key's cut-off, a table of one row a key.
    """
    dealt = rows.withColumn("_b", F.floor(F.col(u) * buckets).cast("int"))
    named = [f"_k_{x}" for x in keys]
    sizes = dealt.groupBy(*[F.col(x).alias(n) for x, n in zip(keys, named, strict=True)], F.col("_b").alias("_kb")).agg(F.count("*").alias("_many"), (F.max(k) if isinstance(k, str) else F.lit(None)).alias("_want"))
    if not isinstance(k, str):
        sizes = sizes.withColumn("_want", F.ceil(F.lit(k) * F.sum("_many").over(W.partitionBy(*named))))
    over = W.partitionBy(*named).orderBy("_kb").rowsBetween(W.unboundedPreceding, 0)
    summed = sizes.withColumn("_upto", F.sum("_many").over(over))
    cut = F.when((F.col("_upto") > F.col("_want")) & (F.col("_upto") - F.col("_many") < F.col("_want")), F.struct("_kb", (F.col("_want") - F.col("_upto") + F.col("_many")).alias("need")))
    full = F.when(F.col("_upto") <= F.col("_want"), F.col("_kb"))
    # Written first, so that its size is known and rows that come from files are not shuffled to meet so few.
    cuts = written(summed.groupBy(*named).agg(F.coalesce(F.max(full), F.lit(-1)).alias("_full"), F.max(cut).alias("_cut")), "cuts")
    met = dealt.join(cuts, same_keys(keys, named))
    edge = F.coalesce(F.col("_b") == F.col("_cut._kb"), F.lit(False))
    place = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(u, *order))
    ranked = met.filter(edge).withColumn(name, place <= F.col("_cut.need"))
    return met.filter(~edge).withColumn(name, F.col("_b") <= F.col("_full")).select(*rows.columns, name).unionByName(ranked.select(*rows.columns, name))


def with_totals(df: DataFrame, keys: list[str], **totals) -> DataFrame:
    """Add aggregates over the keys as columns; a join with one row for each key, whose rows stay dealt as they are."""
    named = [f"_k_{k}" for k in keys]
    by_key = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(by_key, same_keys(keys, named)).drop(*named)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose rows may become many."""
    for b in batches:
        yield from (b.slice(k, SLICE) for k in range(0, b.num_rows, SLICE))


def _places(words: np.ndarray) -> np.ndarray:
    """The bucket of each hash, of ``LEAST_BUCKETS``."""
    return (words.astype(np.int64) * LEAST_BUCKETS) >> 32


def _counted(keys: list[str], n_splits: int, after: bytes):
    """(keys, split, _kb, _many) of rows (keys, _id): how many fall in each bucket by their hash for the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                own = b.column(k).dictionary_encode()
                code = np.unique(code * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy(), return_inverse=True)[1]
            first = np.unique(code, return_index=True)[1]
            rows, split = np.divmod(np.arange(b.num_rows * n_splits), n_splits)
            place = _places(pair_words(b.column("_id"), rows, split, after))
            many = np.bincount((code[rows] * n_splits + split) * LEAST_BUCKETS + place)
            cells = np.flatnonzero(many)
            group, bucket = np.divmod(cells, LEAST_BUCKETS)
            key, split = np.divmod(group, n_splits)
            columns = [b.column(k).take(pa.array(first[key])) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(split.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(many[cells])], names=[*keys, "split", "_kb", "_many"])

    return run


def _hashed(names: list[str], n_splits: int, seed: int):
    """A row for each split in which a row may stay, with its hashes: positives (_one) in all, others up to the bucket of ``_upto``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ids, ones = b.column("_id"), pc.fill_null(b.column("_one"), False).to_numpy(zero_copy_only=False)
            u = np.zeros((b.num_rows, n_splits), np.uint32)
            rows, split = np.divmod(np.arange((~ones).sum() * n_splits), n_splits)
            rows = np.flatnonzero(~ones)[rows]
            u[rows, split] = pair_words(ids, rows, split, str(seed).encode())
            stays = np.repeat(ones[:, None], n_splits, 1)
            lists = b.column("_upto").filter(pa.array(~ones))
            stays[~ones] = _places(u[~ones]) <= lists.flatten().to_numpy().reshape(-1, n_splits)
            rows, split = np.nonzero(stays)
            v = pair_words(ids, rows, split, f"{seed}|role".encode())
            kept = b.select(names).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(split.astype(np.int32)), pa.array(u[rows, split] / 4294967296.0), pa.array(v / 4294967296.0)], names=[*names, "split", "_u", "_v"])

    return run


def split_hashes(base: DataFrame, keys: list[str], row_id: str, label: str, pos: str, n_splits: int, seed: int) -> DataFrame:
    """The rows of ``base`` once for each split in which they may stay, with the hashes _u and _v: all positives, and negatives up to the bucket of _u in
    which the ``pos``-th of their keys lies.

    A row stays one until its hashes are known: they are made twice, to count buckets and to leave out what lies above them.
    """
    schema = base.schema
    rows = base.filter(F.col(label).isNotNull()).withColumn("_id", F.col(row_id).cast("string")).withColumn("_one", F.col(label) == 1)
    asked = T.StructType([*[schema[k] for k in keys], *[T.StructField(n, t) for n, t in (("split", T.IntegerType()), ("_kb", T.IntegerType()), ("_many", T.LongType()))]])
    negatives = spread(rows.filter(~F.col("_one")), *keys, row_id).select(*keys, "_id")
    sizes = negatives.mapInArrow(_counted(keys, n_splits, str(seed).encode()), asked).groupBy(*keys, "split", "_kb").agg(F.sum("_many").alias("_many"))
    wanted = base.groupBy(*[F.col(k).alias(f"_w_{k}") for k in keys]).agg(F.max(pos).alias("_want"))
    summed = sizes.withColumn("_sum", F.sum("_many").over(W.partitionBy(*keys, "split").orderBy("_kb").rowsBetween(W.unboundedPreceding, 0))).join(wanted, same_keys(keys, [f"_w_{k}" for k in keys]))
    reached = summed.groupBy(*keys, "split").agg(F.coalesce(F.min(F.when(F.col("_sum") >= F.col("_want"), F.col("_kb"))), F.lit(LEAST_BUCKETS)).alias("_last"))
    lists = reached.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("split", "_last"))), lambda s: s["_last"]).alias("_upto"))
    # Dealt over the tasks last, as rows become many there.
    met = spread(rows.join(lists, same_keys(keys, [f"_k_{k}" for k in keys]), "left"), *keys, row_id)
    out = T.StructType([*schema.fields, T.StructField("split", T.IntegerType()), T.StructField("_u", T.DoubleType()), T.StructField("_v", T.DoubleType())])
    return met.select(*schema.names, "_id", "_one", "_upto").mapInArrow(_hashed(schema.names, n_splits, seed), out)


def balanced_splits(df: DataFrame, keys: list[str], row_id: str, label: str = "label", n_splits: int = 50, test_fraction: float = 0.3, seed: int = 1, more: list[str] | None = None) -> DataFrame:
    """(keys, row id, label, more, split, role): for each split all positives and as many negatives, of which ceil(f n) test.

    Negatives are drawn without replacement; fewer stay if there are fewer than positives. Ties of the hash
    go by row id. ``more`` names other columns that stay with their row.
    """
    names = [*keys, row_id, label, *(more or [])]
    base = written(with_totals(df.select(*names), keys, _pos=F.sum(label)), "labelled")
    buckets, drawn = bucket_number(base, keys), [*keys, "split"]
    hashed = written(split_hashes(base, keys, row_id, label, "_pos", n_splits, seed), "hashed")
    # Positives all stay, so that only negatives are ranked.
    negatives = among_smallest(hashed.filter(F.col(label) != 1), drawn, "_u", [row_id], "_pos", "_in", buckets).filter("_in")
    chosen = hashed.filter(F.col(label) == 1).select(*names, "split", "_v").unionByName(negatives.select(*names, "split", "_v"))
    ranked = among_smallest(written(chosen, "chosen"), drawn, "_v", [row_id], test_fraction, "_in", buckets)
    return ranked.select(*names, "split", F.when(F.col("_in"), "test").otherwise("train").alias("role"))


def stack_iterations(splits: DataFrame, keys: list[str], row_id: str, label: str = "label") -> DataFrame:
    """(keys, iteration, row id, label): test rows of all splits."""
    return splits.filter("role = 'test'").select(*keys, F.col("split").alias("iteration"), row_id, label)


def combine_genes(splits: DataFrame, groups: DataFrame, gene: str = "gene") -> DataFrame:
    """Split rows of the genes of each group under the group's name. ``groups`` has (name, gene)."""
    return splits.join(groups, gene).drop(gene)


def dedupe_sites(df: DataFrame, keys: list[str], site: list[str], row_id: str) -> DataFrame:
    """The first row of each site within the keys."""
    w = W.partitionBy(*keys, *site).orderBy(row_id)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def balance_classes(df: DataFrame, keys: list[str], label: str, row_id: str, seed: int = 1) -> DataFrame:
    """All rows of the rarer class and as many of the other, chosen by hash rank."""
    u = hash_uniform(F.col(row_id), *[F.col(k) for k in keys], F.lit(seed), F.lit("balance"))
    sized = with_totals(df, keys, _least=F.least(F.sum(label), F.count("*") - F.sum(label)))
    rows = written(sized.withColumn("_u", u), "hashed")
    return among_smallest(rows, [*keys, label], "_u", [row_id], "_least", "_in", bucket_number(rows, keys)).filter("_in").select(*df.columns)


def merge_splits(splits: DataFrame, nodes: DataFrame, ttype: str = "ttype") -> DataFrame:
    """Split rows of every cohort's ttype at each node that contains it: split i meets split i.

    ``nodes`` has (node, member): the ttypes of each subtree. Keys change; rows are not copied into lists.
    """
    return splits.join(nodes, splits[ttype] == nodes["member"]).drop("member", ttype).withColumnRenamed("node", ttype)
