"""Possible mutations of sequences and weighted draws among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from drivescore.functions.uniform import uniforms
from drivescore.functions.variants import hash_uniform, of_bases, pyrimidine_context
from drivescore.operators.boosting import spread
from drivescore.operators.splits import same_keys
from drivescore.sources.tables import written

BASES = "ACGT"
DRAWS = 4096
BROADCAST_ROWS = 200_000
# Draws that a row stands for; candidates and draws of a slice.
RUN_DRAWS, SLICE_ROWS, SLICE_DRAWS = 1_048_576, 65_536, 4_194_304
BATCH_BYTES = 4 << 20


def explode_bases(regions: DataFrame, keys: list[str], start: str = "start", seq: str = "seq") -> DataFrame:
    """(keys, pos, triplet): a row for each base of regions whose sequence has one more base on either side.

    ``start`` is the position of the first base proper. A triplet that is not of ACGT is NULL. Regions are dealt over the tasks first: few
    bytes of them make many rows.
    """
    at = F.explode(F.sequence(F.lit(1), F.length(seq) - 2)).alias("_k")
    dealt = spread(regions.filter(F.length(seq) >= 3).select(*dict.fromkeys([*keys, start, seq])), *keys, start)
    rows = dealt.select(*keys, start, seq, at)
    triplet = F.substring(F.col(seq), F.col("_k"), F.lit(3))
    return rows.select(*keys, (F.col(start) + F.col("_k") - 1).alias("pos"), F.when(of_bases(triplet), triplet).alias("triplet"))


def all_substitutions(bases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, ref, alt, context): the three changes of each base with a known triplet."""
    ref = F.substring("triplet", 2, 1)
    rows = bases.filter("triplet is not null").withColumn("ref", ref).withColumn("alt", F.explode(F.split(F.lit(BASES), "")))
    rows = rows.filter((F.col("alt") != "") & (F.col("alt") != F.col("ref")))
    return rows.select(*keys, "pos", "ref", "alt", pyrimidine_context(F.col("triplet"), F.col("alt")).alias("context"))


def _blocks(df: DataFrame, weight: str, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows, written by ranges of (keys, order) with their range as _block; and what comes before each block of a key.

    Ranges hold about as many rows each, whatever the keys, so a key of most rows is dealt over many. The second table (keys as _k_<key>, _kb) has
    the sum of weights before the block, the key's total, its number of rows, and whether its weights are a distribution (a
    positive sum of weights that aren't negative); where they aren't, each row weighs 1.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = F.coalesce(F.col(weight), F.lit(0.0)).cast("double")
    rows = written(df.withColumn("_w", w).repartitionByRange(parts, *keys, *order).withColumn("_block", F.spark_partition_id()), "weighed")
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    sums = rows.groupBy(*named, F.col("_block").alias("_kb")).agg(F.sum("_w").alias("_sum"), F.min("_w").alias("_least"), F.count("*").alias("_n"))
    key = W.partitionBy(*[f"_k_{k}" for k in keys])
    before = key.orderBy("_kb").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_fine", (F.sum("_sum").over(key) > 0) & (F.min("_least").over(key) >= 0)).withColumn("_many", F.sum("_n").over(key))
    own = F.when(F.col("_fine"), F.col("_sum")).otherwise(F.col("_n").cast("double"))
    sums = sums.withColumn("_own", own).withColumn("_base", F.coalesce(F.sum("_own").over(before), F.lit(0.0))).withColumn("total", F.sum("_own").over(key))
    return rows, sums.select(*[f"_k_{k}" for k in keys], "_kb", "_base", "total", "_many", "_fine")


def _cumulated(df: DataFrame, weight: str, keys: list[str], order: list[str]) -> DataFrame:
    rows, bases = _blocks(df, weight, keys, order)
    met = rows.join(bases, same_keys([*keys, "_block"], [*[f"_k_{k}" for k in keys], "_kb"]))
    met = met.withColumn("_w", F.when(F.col("_fine"), F.col("_w")).otherwise(F.lit(1.0)))
    within = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = met.withColumn("cum_hi", F.col("_base") + F.sum("_w").over(within))
    # The lower end is the row before's upper end, so that ranges meet without a gap.
    low = F.lag("cum_hi").over(W.partitionBy(*keys, "_block").orderBy(*order))
    return out.withColumn("cum_lo", F.coalesce(low, F.col("_base"))).select(*df.columns, "cum_hi", "total", "cum_lo", "_many")


def cumulative_weights(df: DataFrame, weight: str, keys: list[str], order: list[str]) -> DataFrame:
    """Add cum_hi, total and cum_lo: the running sum of weights within the keys, with the row, over all rows, and before the row.

    If a key's weights are no distribution (a sum that is not positive, or a negative weight), its rows weigh 1 each. Sums run over ranges of rows first
    and within a range then, so that no task holds a key whole.
    """
    return _cumulated(df, weight, keys, order).drop("_many")


def weighted_draw(candidates: DataFrame, counts: DataFrame, weight: str, keys: list[str], order: list[str], seed: int = 1, per_row: int = 50, per: tuple[str, ...] = ()) -> DataFrame:
    """Draw ``per_row`` times each key's count rows with replacement, in proportion to the weight.

    ``counts`` has the keys, n and the columns ``per``: the draws of each (per, key) come from the one table of
    the key. Draws are numbered from 1; draw d takes the row whose cumulative range holds u * total, where u is
    the hash uniform of (per, key, d, seed). Draws and ranges meet in cells of u. A key has as many cells as candidates, so
    that a draw is compared with a few of them, and a frequent key is dealt over its cells.
    """
    table = written(_cumulated(candidates, weight, keys, order).filter("cum_hi > cum_lo"), "cumulated")
    own = [f"_k_{k}" for k in keys]
    sizes = table.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)]).agg(F.max("total").alias("_total"), F.max("_many").alias("_cells"))
    cell = lambda x: F.least(F.col("_many") - 1, F.floor(x / F.col("total") * F.col("_many")))
    many = table.agg(F.sum(cell(F.col("cum_hi")) - cell(F.col("cum_lo")) + 1)).first()[0] or 0
    table = table.withColumn("_cell", F.explode(F.sequence(cell(F.col("cum_lo")), cell(F.col("cum_hi"))))).drop("total", "_many")
    names = [*per, *keys]
    # Few keys have all draws: blocks of draws are dealt over the tasks before they are numbered.
    last = (F.col("n") * per_row).cast("long")
    blocks = counts.filter("n > 0").select(*names, last.alias("_last"), F.explode(F.sequence(F.lit(1).cast("long"), last, F.lit(DRAWS).cast("long"))).alias("_from"))
    blocks = blocks.join(sizes, same_keys(keys, own)).drop(*own).repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "_from")
    draws = blocks.select(*names, "_total", "_cells", F.explode(F.sequence("_from", F.least("_last", F.col("_from") + DRAWS - 1))).alias("draw"))
    draws = draws.withColumn("u", hash_uniform(*[F.col(k) for k in names], F.col("draw"), F.lit(seed)))
    # A draw's cell is found from x as a range's cells from its ends; all three steps rise with their input, so rounding parts no draw from its range.
    draws = draws.withColumn("_x", F.col("u") * F.col("_total")).withColumn("_cell", F.least(F.col("_cells") - 1, F.floor(F.col("_x") / F.col("_total") * F.col("_cells")))).drop("_total", "_cells")
    # Cells multiply the rows of a table whose files are small, which Spark would broadcast by their size: it is told to by the rows.
    return draws.join(table.hint("broadcast" if many <= BROADCAST_ROWS else "merge"), [*keys, "_cell"]).filter((F.col("cum_lo") <= F.col("_x")) & (F.col("_x") < F.col("cum_hi"))).drop("_cell", "_x", "cum_lo", "cum_hi")


def _met(u: np.ndarray, total: float, ends: np.ndarray) -> np.ndarray:
    """How many of the draws (uniform numbers times 2^32) each of the ranges holds, which follow one another and end at ``ends``."""
    place = np.searchsorted(ends, u / 4294967296.0 * total, "right")
    return np.bincount(np.minimum(place, len(ends) - 1), minlength=len(ends))


def _count_runs(names: list[str], after: bytes, schema: pa.Schema):
    """Runs of draws with their key's ranges to the draws of each range that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = {n: b[n][k].as_py() for n in (*names, "_total", "_before", "_from", "_last")}
                ends, rows = (b[n][k].values.to_numpy(zero_copy_only=False) for n in ("_ends", "_rows"))
                n = sum(_met(u, r["_total"], ends) for u in uniforms(r["_before"].encode(), r["_from"], r["_last"], after))
                some = np.flatnonzero(n)
                columns = [pa.array([r[c]] * len(some), schema.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[some]), pa.array(n[some])], schema=schema)

    return run


def _slice_runs(names: list[str], after: bytes, schema: pa.Schema):
    """Runs of draws to a row for each slice of the key, with the sorted uniform numbers of its draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                u = np.sort(np.concatenate(list(uniforms(r["_before"].encode(), r["_from"], r["_last"], after))))
                # The steps of a candidate's slices (sliced in drawn_counts), so that rounding parts no draw from its range; each rises with u.
                at = np.minimum(r["_slices"] - 1, np.floor(u / 4294967296.0 * r["_total"] / r["_total"] * r["_slices"])).astype(np.int64)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                parts = [p.tobytes() for p in np.split(u, first[1:])]
                columns = [pa.array([r[c]] * len(first), schema.field(c).type) for c in (*names, "_total")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at[first]), pa.array(parts, pa.binary())], schema=schema)

    return run


def _first_beyond(ends: np.ndarray, total: float) -> np.ndarray:
    """The least draw (uniform number times 2^32) that does not lie below each end, by the steps of ``_met``; 2^32 if all lie below."""
    x = lambda u: u / 4294967296.0 * total
    found = np.ceil(np.clip(ends / total, 0, 1) * 4294967296.0).astype(np.int64)
    while (low := (found > 0) & (x(found - 1) >= ends)).any():
        found -= low
    while (high := (found < 1 << 32) & (x(found) < ends)).any():
        found += high
    return found


def _count_slice(per: tuple[str, ...], columns: list[str], schema: pa.Schema, wide: list | None):
    """The draws and candidates of a slice to the candidates that were drawn, each with its draws by ``per``."""

    def run(draws: pa.Table, candidates: pa.Table) -> pa.Table:
        if not draws.num_rows or not candidates.num_rows:
            return schema.empty_table()
        candidates = candidates.sort_by("cum_hi")
        beyond, places, numbers, whose = _first_beyond(candidates["cum_hi"].to_numpy(), draws["_total"][0].as_py()), [], [], []
        ends, above = np.minimum(beyond, (1 << 32) - 1).astype(np.uint32), beyond == 1 << 32
        groups: dict[tuple, list[int]] = {}
        for k, r in enumerate(draws.select(list(per)).to_pylist()):
            groups.setdefault(tuple(r.values()), []).append(k)
        lists = schema.field("drawn").type
        many = np.zeros((len(candidates), len(wide)), np.int64) if wide else None
        for g, (name, own) in enumerate(groups.items()):
            u = np.sort(np.concatenate([np.frombuffer(draws["u"][k].as_buffer(), np.uint32) for k in own]))
            upto = np.searchsorted(u, ends)
            upto[above] = upto[-1] = len(u)
            n = np.diff(upto, prepend=0)
            if wide:
                many[:, wide.index(name[0])] = n
                continue
            some = np.flatnonzero(n)
            places, numbers, whose = [*places, some], [*numbers, n[some]], [*whose, np.full(len(some), g)]
        if wide:
            drawn = np.flatnonzero(many.any(axis=1))
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(drawn) + 1, dtype=np.int32) * len(wide)), pa.array(many[drawn].ravel()), type=lists)
        else:
            place, number, group = (np.concatenate(v) for v in (places, numbers, whose))
            order = np.argsort(place, kind="stable")
            drawn, first = np.unique(place[order], return_index=True)
            firsts = [own[0] for own in groups.values()]
            fields = [draws[c].take(pa.array(np.array(firsts)[group[order]])).combine_chunks().cast(lists.value_type.field(c).type) for c in per]
            structs = pa.StructArray.from_arrays([*fields, pa.array(number[order])], fields=list(lists.value_type))
            found = pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), structs, type=lists)
        kept = candidates.select(columns).take(pa.array(drawn))
        return pa.table([*[kept[c].cast(schema.field(c).type) for c in columns], found], schema=schema)

    return run


def in_order(name: str, number: str, values: list) -> Column:
    """Aggregate: an array of the sums of ``number`` over the rows of each of the ``values`` of ``name``, in their order."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col(name).eqNullSafe(F.lit(v)), F.col(number))), F.lit(0)).cast("long") for v in values])


def drawn_counts(candidates: DataFrame, counts: DataFrame, weight: str, keys: list[str], order: list[str], seed: int = 1, per_row: int = 50, per: tuple[str, ...] = (), wide: list | None = None) -> DataFrame:
    """The draws of ``weighted_draw`` counted by candidate: its columns but the weight, and drawn, an array of (per, n). Candidates that no draw took are left out.
    With ``wide``, all values of the one column ``per``, drawn is an array of the numbers in their order.

    A candidate of great weight may stand in several rows, whose numbers add up. Draws are made in runs and never rows of their own: of few candidates
    each run counts its draws by the whole table; of more, a key is cut into slices of its range, where the draws
    meet the candidates as four bytes each.
    """
    spark, columns, names = candidates.sparkSession, [c for c in candidates.columns if c != weight], [*per, *keys]
    # A run brings its key's ranges along: a batch of runs has a few MB of them.
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(batch, min(BATCH_BYTES, int(str(spark.conf.get(batch, str(BATCH_BYTES))).rstrip("b"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _cumulated(candidates, weight, keys, order).filter("cum_hi > cum_lo").drop(weight).withColumn("_row", F.monotonically_increasing_id())
    table = written(table, "cumulated")
    own = [f"_k_{k}" for k in keys]
    last = (F.col("n") * per_row).cast("long")
    asked = counts.filter("n > 0").withColumn("_last", last)
    few = table.count() <= BROADCAST_ROWS
    sizes = table.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)]).agg(F.max("total").alias("_total"), F.max("_many").alias("_many"), *(
        [F.sort_array(F.collect_list(F.struct("cum_hi", "_row"))).alias("_l")] if few else []
    ))
    if few:
        sizes = sizes.withColumn("_ends", F.col("_l.cum_hi")).withColumn("_rows", F.col("_l._row")).drop("_l", "_many")
    else:
        all_draws = asked.groupBy(*[F.col(k).alias(f"_d_{k}") for k in keys]).agg(F.sum("_last").alias("_draws"))
        sizes = sizes.join(all_draws, same_keys(own, [f"_d_{k}" for k in keys])).withColumn("_slices", F.ceil(F.greatest(F.col("_many") / SLICE_ROWS, F.col("_draws") / SLICE_DRAWS))).select(*own, "_total", "_slices")
    meet = F.lit(True)
    for k, n in zip(keys, own, strict=True):
        meet = meet & (F.col(k) == F.col(n))
    before = F.concat(*[F.coalesce(F.concat(F.col(n).cast("string"), F.lit("|")), F.lit("")) for n in names])
    runs = asked.select(*names, before.alias("_before"), "_last", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_last"), F.lit(RUN_DRAWS).cast("long"))).alias("_from"))
    runs = runs.withColumn("_last", F.least("_last", F.col("_from") + RUN_DRAWS - 1)).repartition(parts, *names, "_from")
    runs = runs.join(F.broadcast(sizes), meet).drop(*own)
    after = f"|{seed}".encode()
    kind = {c: f"`{c}` {df.schema[c].dataType.simpleString()}" for df in (table, counts) for c in df.columns}
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    if few:
        out = ", ".join([*[kind[c] for c in names], "_row long", "n long"])
        found = runs.mapInArrow(_count_runs(names, after, arrow(out)), out)
        summed = found.groupBy("_row", *per).agg(F.sum("n").alias("n")).groupBy("_row")
        summed = summed.agg((in_order(per[0], "n", wide) if wide else F.collect_list(F.struct(*per, "n"))).alias("drawn"))
        return table.select(*columns, "_row").join(summed, "_row").drop("_row")
    packed = ", ".join([*[kind[c] for c in names], "_total double", "_slice long", "u binary"])
    draws = runs.mapInArrow(_slice_runs(names, after, arrow(packed)), packed)
    cut = lambda x: F.least(F.col("_slices") - 1, F.floor(x / F.col("total") * F.col("_slices")))
    sliced = table.join(F.broadcast(sizes.drop("_total")), meet).drop(*own)
    sliced = sliced.withColumn("_slice", F.explode(F.sequence(cut(F.col("cum_lo")), cut(F.col("cum_hi"))))).select(*columns, "cum_hi", "_slice")
    each = "bigint" if wide else f"struct<{', '.join([*[kind[c].replace('` ', '`:') for c in per], 'n:bigint'])}>"
    out = ", ".join([*[kind[c] for c in columns], f"drawn array<{each}>"])
    at = [*keys, "_slice"]
    left, right = draws.repartition(parts, *at).groupBy(*at), sliced.repartition(parts, *at).groupBy(*at)
    return left.cogroup(right).applyInArrow(_count_slice(per, columns, arrow(out), wide), out)
