"""MinHash near-duplicates: circulant signatures, banding, and exact Jaccard verification of the full sets.

1. ``shingle_rows``: of each document's shingles' 64-bit hashes a digest of their set and the keys of its bands are kept. The signature is circulant: one permutation of [0, 2^32) places the shingles, and coordinate k is the least value that a second
   permutation gives to the places shifted by k around the circle. Two permutations thus make all ``COORDINATES``.
2. Documents of equal sets are one node. Nodes that share a band's key meet there; 50 bands of 6 coordinates find a pair of
   similarity 0.8 but for a chance of 3e-7, of 0.85 but for 3e-11.
3. Each node is compared with the least node of each of its buckets, on full sets. A group of near copies falls together here,
   whatever its size, at one comparison for a node and leader; its pairs are never made.
4. Buckets that hold several components still are joined to blocks, and the sets of a block's nodes go to one task,
   which finds all links between its components through the rarest shingles of each set (``linked``) and gives back a
   spanning part of them. A block beyond ``BLOCK`` shingles is cut into pieces, and pieces meet two at a time; the pieces of
   one component don't meet, as nothing is left to find.
5. Connected components of the links of 3 and 4.

Sets are of 64-bit hashes: two different shingles of a pair of documents of 20,000 each agree with a chance of 2e-11.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, narrow, staged

SEED = 42
BANDS, WIDTH = 50, 6
COORDINATES = BANDS * WIDTH
GROUP_CHARS = 400_000
LINES = 128  # shingles whose coordinates are computed at once
BLOCK = 2_000_000
AGREE = 64  # candidates that are verified at once

U32, U64 = np.uint32, np.uint64
FACTOR = U32(0x85EBCA6B)


def _mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit reaches all bits."""
    h = (h ^ (h >> U64(31))) * U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def shingle_hashes(text: bytes | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles. ``known`` keeps words' hashes."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, U64)
    for w in set(parts).difference(known):
        known[w] = xxh64_intdigest(w, SEED)
    own = np.fromiter(map(known.__getitem__, parts), U64, len(parts))
    n = max(1, len(parts) - words + 1)
    h = np.full(n, min(words, len(parts)), U64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(parts))):
            h = _mix64(h ^ own[k : k + n])
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Circulant MinHash of non-empty sets of hashes: a row of ``COORDINATES`` 32-bit values for each."""
    out = np.full((len(sets), COORDINATES), 0xFFFFFFFF, U32)
    # Places shifted by k and multiplied are the products shifted by k times the factor.
    shift = np.arange(COORDINATES, dtype=U32) * FACTOR
    x, y = np.empty((LINES, COORDINATES), U32), np.empty((LINES, COORDINATES), U32)
    for own, hashes in zip(out, sets, strict=True):
        place = hashes.astype(U32)
        for down, by in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            place ^= place >> U32(down)
            place *= U32(by)
        place ^= place >> U32(16)
        place *= FACTOR
        for begin in range(0, len(place), LINES):
            part = place[begin : begin + LINES, None]
            a, b = x[: len(part)], y[: len(part)]
            np.add(part, shift, out=a)
            np.right_shift(a, U32(15), out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, U32(0xC2B2AE35), out=a)
            np.minimum(own, np.minimum.reduce(a, axis=0), out=own)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` 64-bit keys for each signature: of the band's number and coordinates."""
    pieces = signature.reshape(len(signature), BANDS, WIDTH).astype(U64)
    h = np.broadcast_to(np.arange(BANDS, dtype=U64), pieces.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(0, WIDTH, 2):
            h = _mix64(h ^ (pieces[:, :, k] << U64(32) | pieces[:, :, k + 1]))
    return h


def _list(rows: list[np.ndarray] | np.ndarray) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, U64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(flat).view(np.int64)))


def digest_of(own: np.ndarray) -> tuple[int, int]:
    """Two sums over a set's hashes, as signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        both = np.array([own.sum(dtype=U64), _mix64(own).sum(dtype=U64)])
    return tuple(both.view(np.int64).tolist())


def _groups(texts: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """The sets of consecutive texts, in groups of about ``GROUP_CHARS``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = 0
    while begin < len(texts):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), GROUP_CHARS, "right")))
        known: dict[bytes, int] = {}
        yield [shingle_hashes(t.as_py(), words, known) for t in texts.slice(begin, end - begin)]
        begin = end


def shingle_rows(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, row, h, n, d1, d2, bands) of every row; h is the text's hash, n the size of its set; a row without shingles has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin = 0
            for sets in _groups(b.column(3), words):
                some = [k for k, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[k] for k in some]))
                at = dict(zip(some, keys, strict=True))
                digests = [digest_of(s) for s in sets]
                own = b.slice(begin, len(sets))
                columns = [*own.columns[:3], pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([*columns, _list([at.get(k, keys[:0].ravel()) for k in range(len(sets))])], names=["id", "row", "h", "n", "d1", "d2", "bands"])
                begin += len(sets)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t"))
    return bounded_batches(rows).mapInArrow(run, f"id {kind}, row long, h long, n long, d1 long, d2 long, bands array<long>")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(n, d1, d2, shingles) of texts (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets in _groups(b.column(0), words):
                digests = [digest_of(s) for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), _list(sets)]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "d1", "d2", "shingles"])

    return texts.select(F.col("t").cast("binary").alias("t")).mapInArrow(run, "n long, d1 long, d2 long, shingles array<long>")


def linked(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, least: Fraction) -> list[tuple[int, int]]:
    """Pairs of ``sets`` of similarity ``least`` or more that join different components, as many as it takes to join them all.

    ``sets`` are sorted hashes, ``comp`` the components they are in by now. Only pairs of different ``side`` are looked at, or all where
    it is the same throughout. A set of n shingles shares one of its n - ceil(least * n) + 1 rarest with any set so similar to it, in whatever
    order all sets keep; of the sets found by these, those of fitting size and another component are verified in full.
    """
    comp, found = comp.copy(), []
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    names, flat = np.unique(flat, return_inverse=True)
    ends = np.cumsum(size)
    both = len(np.unique(side)) > 1
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, np.bincount(flat)))] = np.arange(len(names))
    tokens = [np.sort(rank[flat[e - n : e]]) for e, n in zip(ends, size, strict=True)]
    lead = [t[: len(t) - -(-len(t) * least.numerator // least.denominator) + 1] for t in tokens]
    owner = np.repeat(np.arange(len(sets)), [len(t) for t in lead])
    posting = np.concatenate(lead)
    by = np.argsort(posting, kind="stable")
    owner, first = owner[by], np.searchsorted(posting[by], np.arange(len(names) + 1))
    held = np.zeros(len(names), bool)
    for a in range(len(sets)):
        near = np.unique(np.concatenate([owner[first[t] : first[t + 1]] for t in lead[a]]))
        small, large = np.minimum(size[near], size[a]), np.maximum(size[near], size[a])
        near = near[(near > a) & (comp[near] != comp[a]) & (small * least.denominator >= large * least.numerator)]
        near = near[side[near] != side[a]] if both else near
        if not len(near):
            continue
        held[tokens[a]] = True
        while len(near):
            some, near = near[:AGREE], near[AGREE:]
            starts = np.concatenate(([0], np.cumsum(size[some])[:-1]))
            common = np.add.reduceat(held[np.concatenate([tokens[k] for k in some])].astype(np.int64), starts)
            alike = some[common * least.denominator >= (size[some] + size[a] - common) * least.numerator]
            for k in alike:
                if comp[k] != comp[a]:
                    found.append((a, int(k)))
                    comp[comp == comp[k]] = comp[a]
            near = near[comp[near] != comp[a]]
        held[tokens[a]] = False
    return found


def _block_links(least: Fraction):
    """Rows sorted by pair (pair, side, node, comp, shingles) to spanning links (a, b) between the components of each pair of pieces."""

    def links(rows: list[tuple]) -> tuple[list[int], list[int]]:
        side, node, comp = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        pairs = linked([r[3] for r in rows], comp, side, least)
        return [int(node[a]) for a, _ in pairs], [int(node[b]) for _, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = batch.column(4)
            flat, offsets = sets.values.to_numpy(zero_copy_only=False).view(U64), sets.offsets.to_numpy()
            for k, (pair, side, node, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if pair != now:
                    if len(rows) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(rows)], names=["a", "b"])
                    now, rows = pair, []
                rows.append((side, node, comp, flat[offsets[k] : offsets[k + 1]].copy()))
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(rows)], names=["a", "b"])

    return run


def block_links(members: DataFrame, sets: DataFrame, least: Fraction, most: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes of one block and different components. ``members`` is (block, node, comp, n), ``sets`` (node, shingles).

    A block of more than ``most`` shingles is cut into pieces: a component so large is cut by nodes, the others are dealt by components.
    """
    per = members.groupBy("block", "comp").agg(F.sum("n").alias("held")).withColumn("cuts", F.ceil(F.col("held") / most).cast("int"))
    rest = per.filter("cuts = 1").groupBy("block").agg(F.ceil(F.sum("held") / most).cast("int").alias("rest"))
    sized = per.join(rest, "block", "left").select("block", "comp", "cuts", "rest")
    big = F.col("cuts") > 1
    pieces = staged(
        members.join(sized, ["block", "comp"]).select(
            "block", "node", "comp",
            F.when(big, F.col("comp")).alias("own"),
            F.when(big, F.pmod(F.xxhash64("node"), F.col("cuts"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("rest"))).alias("part"),
        ).withColumn("piece", F.xxhash64("block", "own", "part")), "pieces")
    named = pieces.select("block", "piece", "own").distinct()
    other = named.select("block", F.col("piece").alias("piece2"), F.col("own").alias("own2"))
    # Pieces of one component don't meet; a piece of many components meets itself.
    meet = named.join(other, "block").filter("piece <= piece2 and (own is null or own2 is null or own <> own2)")
    meet = meet.filter("piece <> piece2 or own is null").withColumn("pair", F.xxhash64("piece", "piece2"))
    sides = meet.select("pair", "piece", F.lit(0).alias("side")).unionByName(meet.filter("piece <> piece2").select("pair", F.col("piece2").alias("piece"), F.lit(1).alias("side")))
    rows = pieces.join(sides, "piece").join(sets, "node").select("pair", F.col("side").cast("long").alias("side"), "node", "comp", "shingles")
    return rows.repartition("pair").sortWithinPartitions("pair", "side", "node").mapInArrow(_block_links(least), "a long, b long")


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: str = "0.8", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs of anything but space and U+0009 to U+000D, with A to Z in lower case. A document's set holds its distinct
    shingles of ``words`` words; with fewer words, the whole sequence is one. Documents link where their sets' intersection is at least
    ``least`` of their union. A document without words, or of null text, has an empty set and links with none. component_id is the smallest id
    that links reach (null ids are passed over; it is null if all are); ``kept`` tells whether it is the row's own, so that rows
    which repeat an id share its answer, and rows without any id in their component stay. Repeated rows each give a row. An empty table gives no rows. Other
    columns are ignored.
    """
    share = Fraction(least)
    rows = staged(shingle_rows(docs, id_col, text_col, words), "shingles")
    first = F.min(F.struct("row", "h"))
    nodes = staged(rows.filter("n > 0").groupBy("d1", "d2", "n").agg(first.alias("f"), F.min("id").alias("low")).select("d1", "d2", "n", "low", F.col("f.row").alias("node"), F.col("f.h").alias("h")), "nodes")
    own = staged(rows.select(F.col("row").alias("node"), "n", "bands").join(narrow(nodes.select("node")), "node", "left_semi"), "bands")
    buckets = own.select("node", "n", F.explode("bands").alias("band"))
    shared = staged(buckets.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("many")).filter("many > 1").select("band", "lead"), "shared")
    met = staged(buckets.join(narrow(shared), "band").select("band", "node", "lead", "n"), "met")
    stars = met.filter("node <> lead").groupBy("node", "lead").agg(F.max("n").alias("n"))
    # Sets are made again, of the nodes that met others, from their texts: sets of all documents would take more room than the texts.
    asked = staged(nodes.join(met.select("node").distinct(), "node", "left_semi"), "asked")
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).join(narrow(asked.select("h").distinct()), "h", "left_semi").distinct()
    sets = staged(sets_of(texts, words).join(asked.select("n", "d1", "d2", "node"), ["n", "d1", "d2"]).select("node", "n", "shingles"), "sets")
    up, down = F.lit(share.denominator), F.lit(share.numerator)
    led = sets.select(F.col("node").alias("lead"), F.col("n").alias("m"), F.col("shingles").alias("others"))
    held = stars.join(led.select("lead", "m"), "lead").filter(F.least("n", "m") * up >= F.greatest("n", "m") * down)
    both = held.select("node", "lead").join(sets, "node").join(led, "lead")
    common = F.size(F.array_intersect("shingles", "others"))
    links = staged(both.withColumn("common", common).filter(F.col("common") * up >= (F.col("n") + F.col("m") - F.col("common")) * down).select(F.col("node").alias("a"), F.col("lead").alias("b")), "links")
    roots = staged(connected_components(links), "roots")
    # Buckets with several components, joined where they share a node.
    at = met.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    open_ = at.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
    mixed = staged(at.join(open_, "band", "left_semi").select("node", "lead", "comp", "n"), "mixed")
    blocks = connected_components(mixed.select(F.col("node").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("root", "block")
    members = mixed.select("node", "comp", "n").distinct().join(blocks, "node")
    more = block_links(members, sets.select("node", "shingles"), share, block)
    joined = connected_components(links.unionByName(more))
    named = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = staged(named.join(lowest, "root").select("d1", "d2", "n", "component_id"), "components")
    # Spark splits a class of very many rows where it isn't broadcast.
    full = rows.filter("n > 0").select("id", "n", "d1", "d2").join(answer, ["d1", "d2", "n"]).select("id", "n", "component_id")
    all_rows = full.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return all_rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
with recursive d as materialized (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d),
e as materialized (select doc_id, len(s) as n, hash(unnest(s)) as h from s),
p as materialized (
  select x.doc_id as a, y.doc_id as b, count(*) as k, any_value(x.n) as n, any_value(y.n) as m
  from e x join e y on x.h = y.h and x.doc_id < y.doc_id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by 1, 2),
l as materialized (select a, b from p where 100 * k >= 80 * (n + m - k)),
mutual as materialized (select a, b from l union all select b, a from l),
reach(doc_id, other) as (select doc_id, doc_id from s union select r.doc_id, b.b from reach r join mutual b on b.a = r.other),
c as (select doc_id, min(other) as component_id from reach group by 1)
select s.doc_id, cast(len(s) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from s join c on s.doc_id = c.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Two-word shingles, as its contract says."""
    return minhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
