"""SimHash near-duplicates through BK-trees over shards of fingerprints.

1. Each document gets a 64-bit fingerprint (``fingerprints``, Arrow batches).
2. Equal fingerprints become one node that keeps its smallest document id.
3. Two fingerprints that differ in at most 2 bits agree on at least two of four 16-bit blocks, so
   every node goes to the six shards named by its pairs of blocks. Within each shard a BK-tree is
   built (children keyed by their Hamming distance to the parent) and searched with the shard's
   own nodes, following only edges within the radius. A branch whose nodes are already in one
   component with the nodes that ask is not followed, so dense groups of near copies cost about
   one pass for each root, and a shard gives back a spanning star, never its pairs.
   A shard of more than ``large`` nodes is split once more by pairs of 8-bit blocks of the other
   32 bits, which is exact in the same way and leaves at most 65,536 nodes in a shard.
4. The stars of all shards meet in distributed connected components.

The trees go with the shards instead of being broadcast: a broadcast of all trees would grow with
the corpus, a shard is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, connected_components, staged

SEED = 42
RADIUS = 2
CHUNK = 1 << 18
HOT_ROWS = 65_536


def simhash(text: str | None, words: int = 3) -> int:
    """Fingerprint of a text as an unsigned integer; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n < words:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    total, shingles = np.zeros(64, np.int64), n - words + 1
    for k in range(0, shingles, CHUNK):
        cut = map(joined.__getitem__, map(slice, starts[k : k + CHUNK], stops[k : k + CHUNK]))
        hashes = np.fromiter(map(xxh64_intdigest, cut, repeat(SEED)), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > shingles, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) for every row; null text: 0. ``keep``: a long to carry as h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["id", "fp", *b.schema.names[2:]])

    kind = docs.schema[id_col].dataType.simpleString()
    more = [F.col(keep).alias("h")] if keep else []
    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *more).mapInArrow(run, f"id {kind}, fp long" + ", h long" * bool(keep))


def bk_components(nodes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct uint64 ``nodes``, the place of the first node of its component.

    Walks the BK-tree of the nodes with all of them as queries at once: a tree node stands for the
    array of its subtree, whose first entry is its root; children are the parts of equal distance
    to the root. Queries go down only edges within the radius.
    """
    n = len(nodes)
    comp = np.arange(n)

    def unite(places: np.ndarray) -> None:
        labels = np.unique(comp[places])
        if len(labels) > 1:
            comp[np.isin(comp, labels)] = labels[0]

    stack = [(comp.copy(), comp.copy())]
    while stack:
        tree, ask = stack.pop()
        if len(tree) * len(ask) <= 4096:
            near = np.bitwise_count(nodes[tree][:, None] ^ nodes[ask][None, :]) <= radius
            for k in np.flatnonzero(near.any(1)):
                unite(np.append(ask[near[k]], tree[k]))
            continue
        root, below = tree[0], tree[1:]
        d_ask = np.bitwise_count(nodes[ask] ^ nodes[root]).astype(np.int16)
        unite(np.append(ask[d_ask <= radius], root))
        d_below = np.bitwise_count(nodes[below] ^ nodes[root]).astype(np.int16)
        for edge in np.unique(d_below):
            part, sub = below[d_below == edge], ask[np.abs(d_ask - edge) <= radius]
            labels = comp[part]
            if len(sub) and (labels == labels[0]).all():
                sub = sub[comp[sub] != labels[0]]
            if len(sub):
                stack.append((part, sub))
    return comp


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, fp) to edges (a, b) of one star for each component of a shard."""
    shard, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def flush(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        cuts = np.flatnonzero(np.diff(shard)) + 1
        begins, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(shard)])))
        two = begins[sizes == 2]
        near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= RADIUS
        a.append(fp[two + 1][near])
        b.append(fp[two][near])
        for at, size in zip(begins[sizes > 2], sizes[sizes > 2], strict=True):
            own = fp[at : at + size]
            first = bk_components(own.view(np.uint64))
            moved = first != np.arange(size)
            a.append(own[moved])
            b.append(own[first[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        shard = np.concatenate((shard, batch.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(shard) > 50_000 and (last := int(np.searchsorted(shard, shard[-1]))):
            yield flush(shard[:last], fp[:last])
            shard, fp = shard[last:], fp[last:]
    if len(shard):
        yield flush(shard, fp)


def near_links(nodes: DataFrame, large: int = 4096) -> DataFrame:
    """Spanning edges (a, b) over distinct fingerprints ``fp`` of which every link is a path."""

    def block(i: int, bits: int):
        return F.shiftrightunsigned("fp", i * bits).bitwiseAND(F.lit((1 << bits) - 1))

    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]

    def shard_of(at: int, *parts):
        return F.xxhash64(F.lit(at), *parts)

    first = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), block(i, 16).alias("x"), block(j, 16).alias("y")) for k, (i, j) in enumerate(pairs)])).alias("s")).select("fp", "s.*")
    hot = first.groupBy("k", "x", "y").count().filter(F.col("count") > large).select("k", "x", "y", F.lit(True).alias("hot"))
    marked = first.join(hot, ["k", "x", "y"], "left")
    finer = []
    for k, (i, j) in enumerate(pairs):
        rest = [h for g in range(4) if g not in (i, j) for h in (2 * g, 2 * g + 1)]
        finer.append(F.when(F.col("k") == k, F.array(*[shard_of(100 + 6 * k + m, "x", "y", block(rest[p], 8), block(rest[q], 8)) for m, (p, q) in enumerate(pairs)])))
    shards = marked.select("fp", F.explode(F.when(F.col("hot"), F.coalesce(*finer)).otherwise(F.array(shard_of(-1, "k", "x", "y")))).alias("shard"))
    return shards.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_stars, "a long, b long")


def with_components(rows: DataFrame) -> DataFrame:
    """``rows`` (id, fp and more) with component_id: the smallest id that links reach."""
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "nodes")
    roots = connected_components(near_links(nodes)).withColumnRenamed("node", "fp")
    members = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(members.join(lowest, "root").select("fp", "n", "component_id"), "components")
    # Fingerprints of very many rows are at most rows / HOT_ROWS: they are broadcast, so that none of their rows moves.
    hot = named.filter(F.col("n") > HOT_ROWS).select(F.col("fp").alias("hot_fp"), F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), F.col("fp") == F.col("hot_fp"), "left").drop("hot_fp")
    rest = marked.filter("hot is null").drop("hot", "hot_id").join(named.filter(F.col("n") <= HOT_ROWS).select("fp", "component_id"), "fp")
    return marked.filter("hot").withColumn("component_id", F.col("hot_id")).select(*rows.columns, "component_id").unionByName(rest.select(*rows.columns, "component_id"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id.

    Words are runs of anything but space and U+0009 to U+000D, with A to Z in lower case; shingles
    are three words, repeats included; a shorter text is one shingle, and a null text or one
    without words has fingerprint zero, which links like any other. Fingerprints link at 2 or fewer
    differing bits; component_id is the smallest id that links reach (null ids are passed over; it
    is null if all are). Repeated rows each give a row. An empty table gives no rows. Other columns
    are ignored.
    """
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    return with_components(rows).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component.

    It is the row with the smallest id, null ids after all others; of several rows with that id the one whose text has the smallest
    hash. Rows are told apart by id and text, so rows that share an id with a copy, or have none, stay if
    their own component has no better. Of repeated rows one stays. Null and empty texts are copies of each
    other. An empty table gives no rows.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = staged(fingerprints(docs.withColumn("__h", text_hash), id_col, text_col, keep="__h"), "fingerprints")
    # Components without any id are named by their fingerprints' root, so that they do not mix.
    numbered = with_components(rows.withColumnRenamed("id", "own").withColumn("id", F.col("fp")))
    best = F.min(F.struct(F.col("own").isNull().alias("none"), F.col("own").alias("id"), F.col("h").alias("h")))
    stay = numbered.groupBy("component_id").agg(best.alias("b")).select(F.coalesce(F.col("b.id").cast("string"), F.lit("")).alias("__id"), F.col("b.none").alias("__none"), F.col("b.h").alias("__h"))
    keys = ["__id", "__none", "__h"]
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__none": F.col(id_col).isNull(), "__h": text_hash})
    one = W.partitionBy(*keys).orderBy(F.lit(1))
    return keyed.join(stay, keys, "left_semi").withColumn("__one", F.row_number().over(one)).filter("__one = 1").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
