"""Range joins by a hierarchy of bins: each interval lies in at most two bins of the level that fits its length.

A level's bins are ``STEP`` times as wide as those of the level below. A point asks the one bin of each level that intervals are on, an
interval at most two. Level and bin are part of an equi-join key, so that a join on a chromosome is dealt over its bins and a
range as long as a chromosome makes no more rows than a short one; the exact condition is the residual. Nothing is broadcast unless Spark finds it small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivescore.operators.tree import above, ancestor_map
from drivescore.sources.tables import written

BIN = 256
STEP = 4
WIDE_BIN = 4096


def level_of(length: Column, width: int = BIN) -> Column:
    """The lowest level whose bins are wider than ``length``: 0 below ``width``, 1 below 4 ``width``, and so on."""
    times = F.floor(length / width)
    # Two binary digits a level.
    return F.when(times <= 0, 0).otherwise(F.floor((F.length(F.bin(times)) + 1) / 2)).cast("int")


def bin_of(pos: Column, level: Column, width: int = BIN) -> Column:
    return F.floor(pos / (F.lit(float(width)) * F.pow(F.lit(float(STEP)), level)))


def in_bins(intervals: DataFrame, lo: str, hi: str, width: int = BIN) -> DataFrame:
    """Each interval with its _level, once for each bin (_bin) that the closed range [lo, hi] touches there; none if it is empty."""
    kept = intervals.filter(F.col(lo) <= F.col(hi)).withColumn("_level", level_of(F.col(hi) - F.col(lo), width))
    return kept.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(lo), F.col("_level"), width), bin_of(F.col(hi), F.col("_level"), width))))


def levels_in(intervals: DataFrame, lo: str, hi: str, width: int = BIN) -> list[int]:
    """The levels of the intervals: a dozen at most for positions of a genome."""
    return sorted(r[0] for r in intervals.filter(F.col(lo) <= F.col(hi)).select(level_of(F.col(hi) - F.col(lo), width)).distinct().collect())


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, lo: str, hi: str, where: Column, width: int = BIN) -> DataFrame:
    """Pairs of points and intervals of equal keys that satisfy ``where``, a condition within [lo, hi]."""
    levels = levels_in(intervals, lo, hi, width) or [0]
    asked = [F.struct(F.lit(n).alias("level"), bin_of(F.col(pos), F.lit(n), width).alias("bin")) for n in levels]
    left = points.withColumn("_at", F.explode(F.array(*asked)))
    right = in_bins(intervals.withColumnsRenamed({k: f"_r_{k}" for k in keys}), lo, hi, width)
    # The bin first: the join sorts by it before the others, and few rows are alike in it.
    on = (F.col("_at.bin") == F.col("_bin")) & (F.col("_at.level") == F.col("_level")) & where
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right, on).drop("_at", "_level", "_bin", *[f"_r_{k}" for k in keys])


def interval_levels(sites: DataFrame, clusters: DataFrame, name: str = "level", chrom: str = "chr", pos: str = "pos", ttype: str = "ttype", width: int = BIN) -> DataFrame:
    """(chrom, pos, ttype, level) of the distinct sites that lie in any interval: 2 in one of their own ttype, else 1."""
    there = clusters.select(F.col(chrom), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col(ttype).alias("_t"))
    hits = points_in(sites.select(chrom, pos, ttype).distinct(), there, [chrom], pos, "_lo", "_hi", F.col(pos).between(F.col("_lo"), F.col("_hi")), width=width)
    return hits.groupBy(chrom, pos, ttype).agg(F.max(F.when(F.col("_t") == F.col(ttype), 2).otherwise(1)).alias(name))


def interval_membership(df: DataFrame, clusters: DataFrame, name: str = "level", chrom: str = "chr", pos: str = "pos", ttype: str = "ttype", width: int = BIN) -> DataFrame:
    """Add the cluster level of each row: 2 in an interval [lo, hi] of its own ttype, 1 in one of any, 0 in none.

    Levels are found for the distinct sites and joined back, so rows do not multiply.
    """
    return df.join(interval_levels(df, clusters, name, chrom, pos, ttype, width), [chrom, pos, ttype], "left").na.fill(0, [name])


def sites_by_level(df: DataFrame, clusters: DataFrame, closure: DataFrame, site: list[str], name: str = "level", chrom: str = "chr", pos: str = "pos", ttype: str = "ttype", width: int = BIN) -> DataFrame:
    """(node, level, n_unique): distinct sites of the rows under each tree node, by the cluster level that ``interval_membership`` gives the rows.

    A site is one row with its ttypes, meets its position's clusters once, and tells in place which nodes it counts for, so that the tree multiplies
    nothing that moves.
    """
    sites = written(df.groupBy(*site).agg(F.collect_set(ttype).alias("_own")), "level_sites")
    met = sites.join(types_at(sites, clusters, "_types", chrom, pos, ttype, width), [pos, chrom], "left").crossJoin(F.broadcast(ancestor_map(closure, "_above")))
    level = lambda t: F.when(F.array_contains("_types", t), 2).when(F.col("_types").isNotNull(), 1).otherwise(0)
    counted = F.flatten(F.transform("_own", lambda t: F.transform(above("_above", t), lambda a: F.struct(a.alias("node"), level(t).alias(name)))))
    return met.select(F.explode(F.array_distinct(counted)).alias("_at")).groupBy("_at.node", f"_at.{name}").agg(F.count("*").alias("n_unique"))


def domain_levels(sites: DataFrame, domains: DataFrame, name: str = "level", gene: str = "gene", pos: str = "pos", ttype: str = "ttype", width: int = BIN) -> DataFrame:
    """(gene, pos, ttype, level, motif) of the distinct sites that lie in any domain; see ``domain_membership``."""
    there = domains.select(F.col(gene), F.col("start_pos").alias("_lo"), F.col("stop_pos").alias("_hi"), F.col("element").alias("_e"), F.col(ttype).alias("_t"), F.col("ord").alias("_o"))
    inside = (F.col(pos) > F.col("_lo")) & (F.col(pos) < F.col("_hi"))
    hits = points_in(sites.select(gene, pos, ttype).distinct(), there, [gene], pos, "_lo", "_hi", inside, width=width).withColumn("_own", F.col("_t") == F.col(ttype))
    level = F.max(F.when(F.col("_own"), 2).otherwise(1))
    entries = F.sort_array(F.collect_set(F.struct("_o", "_e", "_own")), asc=False)  # a domain once, under however many ttypes it stands
    found = hits.groupBy(gene, pos, ttype).agg(level.alias(name), entries.alias("_l"))
    shown = F.filter("_l", lambda x: x["_own"] | (F.col(name) == 1))
    return found.withColumn("motif", F.array_join(F.transform(shown, lambda x: F.concat(x["_e"], F.lit(";"))), "")).drop("_l")


def domain_membership(df: DataFrame, domains: DataFrame, name: str = "level", gene: str = "gene", pos: str = "pos", ttype: str = "ttype", width: int = BIN) -> DataFrame:
    """Add level (2, 1, 0) and motif for open ranges start < pos < stop of the gene.

    The motif lists the elements hit, each with a semicolon, the last of the table first: those of the row's
    own ttype if any, else those of all ttypes. ``domains`` has gene, start_pos, stop_pos, element, ttype, ord.
    """
    return df.join(domain_levels(df, domains, name, gene, pos, ttype, width), [gene, pos, ttype], "left").na.fill({name: 0, "motif": ""})


def signal_values(sites: DataFrame, signal: DataFrame, name: str = "signal", chrom: str = "chr", pos: str = "pos", width: int = BIN) -> DataFrame:
    """(chrom, pos, value) of the distinct sites that lie in a signal range start < pos <= end."""
    named = F.when(F.length(chrom) < 3, F.concat(F.lit("chr"), F.col(chrom))).otherwise(F.col(chrom))
    there = signal.select(F.col("chrom").alias("_c"), F.col("start").alias("_lo"), F.col("end").alias("_hi"), F.col("value").alias("_v"))
    hits = points_in(sites.select(chrom, pos).distinct().withColumn("_c", named), there, ["_c"], pos, "_lo", "_hi", (F.col(pos) > F.col("_lo")) & (F.col(pos) <= F.col("_hi")), width=width)
    return hits.groupBy(chrom, pos).agg(F.min("_v").alias(name))


def signal_at_point(df: DataFrame, signal: DataFrame, name: str = "signal", chrom: str = "chr", pos: str = "pos", width: int = BIN) -> DataFrame:
    """Add the value of the signal range start < pos <= end; NULL outside. Names under 3 characters get a chr."""
    return df.join(signal_values(df, signal, name, chrom, pos, width), [chrom, pos], "left")


def types_at(sites: DataFrame, clusters: DataFrame, name: str = "types", chrom: str = "chr", pos: str = "pos", ttype: str = "ttype", width: int = BIN) -> DataFrame:
    """(chrom, pos, types): the distinct ttypes of the intervals [lo, hi] in which a site lies, of the sites that lie in any."""
    there = clusters.select(F.col(chrom), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col(ttype).alias("_t"))
    hits = points_in(sites.select(chrom, pos).distinct(), there, [chrom], pos, "_lo", "_hi", F.col(pos).between(F.col("_lo"), F.col("_hi")), width=width)
    return hits.groupBy(chrom, pos).agg(F.collect_set("_t").alias(name))


def domains_at(sites: DataFrame, domains: DataFrame, name: str = "domains", gene: str = "gene", pos: str = "pos", ttype: str = "ttype", width: int = BIN) -> DataFrame:
    """(gene, pos, domains): distinct (ord, element, ttype) of the domains start < pos < stop in which a site lies, the last first."""
    there = domains.select(F.col(gene), F.col("start_pos").alias("_lo"), F.col("stop_pos").alias("_hi"), F.struct(F.col("ord"), F.col("element"), F.col(ttype).alias("ttype")).alias("_d"))
    hits = points_in(sites.select(gene, pos).distinct(), there, [gene], pos, "_lo", "_hi", (F.col(pos) > F.col("_lo")) & (F.col(pos) < F.col("_hi")), width=width)
    return hits.groupBy(gene, pos).agg(F.sort_array(F.collect_set("_d"), asc=False).alias(name))


def overlap_pairs(df: DataFrame, regions: DataFrame, chrom: str, start: str, end: str, width: int = BIN) -> DataFrame:
    """(_c, _s, _e, the regions' other columns) of the distinct half-open ranges of ``df`` and the regions that they overlap.

    ``regions`` has chr, r_start, r_end and more. Distinct sites and regions lie in the bins of their own level, and are asked for in those of
    each level above; a pair is made on the higher of its two levels, in the bin where the overlap begins, so it is made once.
    """
    sites = df.select(F.col(chrom).alias("_c"), F.col(start).alias("_s"), F.col(end).alias("_e")).filter("_s < _e").distinct()
    there = regions.filter(F.col("r_start") < F.col("r_end"))
    cut, right = sites.withColumn("_last", F.col("_e") - 1), there.withColumn("_rlast", F.col("r_end") - 1)
    levels = sorted({*levels_in(cut, "_s", "_last", width), *levels_in(right, "r_start", "_rlast", width)}) or [0]

    def touched(lo: str, hi: str, n: int) -> Column:
        bins = F.sequence(bin_of(F.col(lo), F.lit(n), width), bin_of(F.col(hi), F.lit(n), width))
        return F.transform(bins, lambda b: F.struct(F.lit(n).alias("level"), b.alias("bin")))

    def spread(side: DataFrame, lo: str, hi: str, own: str, at: str) -> DataFrame:
        leveled = side.withColumn(own, level_of(F.col(hi) - F.col(lo), width))
        each = F.flatten(F.array(*[F.when(F.lit(n) >= F.col(own), touched(lo, hi, n)).otherwise(F.array()) for n in levels]))
        return leveled.withColumn(at, F.explode(each))

    left, right = spread(cut, "_s", "_last", "_own", "_at"), spread(right, "r_start", "_rlast", "_rown", "_rat")
    once = (F.greatest("_own", "_rown") == F.col("_at.level")) & (bin_of(F.greatest(F.col("_s"), F.col("r_start")), F.col("_at.level"), width) == F.col("_at.bin"))
    on = (F.col("_c") == right[chrom]) & (F.col("_at") == F.col("_rat")) & (F.col("_s") < F.col("r_end")) & (F.col("r_start") < F.col("_e")) & once
    return left.join(right, on).drop("_last", "_own", "_at", "_rlast", "_rown", "_rat", chrom)


def region_overlap_outer(df: DataFrame, regions: DataFrame, chrom: str = "chr", start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Left outer join on half-open overlap: a row for each (row, region) pair, and rows without a region. ``regions`` has chr, r_start, r_end and more."""
    same = (F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e")) & (F.col(chrom) == F.col("_c"))
    return df.join(overlap_pairs(df, regions, chrom, start, end, width), same, "left").drop("_c", "_s", "_e")


def region_overlap_counts(df: DataFrame, regions: DataFrame, name: str, chrom: str = "chr", start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Add the number of rows that ``region_overlap_outer`` makes of each row, 1 at least; rows do not multiply."""
    counted = overlap_pairs(df, regions, chrom, start, end, width).groupBy("_c", "_s", "_e").agg(F.count("*").alias(name))
    same = (F.col(start) == F.col("_s")) & (F.col(end) == F.col("_e")) & (F.col(chrom) == F.col("_c"))
    return df.join(counted, same, "left").drop("_c", "_s", "_e").na.fill(1, [name])


def occupied(spans: list[tuple[DataFrame, str, str]], name: str, width: int = WIDE_BIN) -> DataFrame:
    """(name): the bins of positions that any of the tables' ranges (table, lo, hi) touches, whatever their chromosome: 524,288 at most for positions of four bytes."""
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    ends = [df.select(at(lo).alias("_a"), at(hi).alias("_b")).filter("_a <= _b").distinct() for df, lo, hi in spans]
    longest = reduce(DataFrame.unionByName, ends).groupBy("_a").agg(F.max("_b").alias("_b"))
    # What the ranges before reach is left out, so that a bin is made once however long the ranges are.
    before = longest.withColumn("_done", F.max("_b").over(W.orderBy("_a").rowsBetween(W.unboundedPreceding, -1)))
    rest = before.withColumn("_a", F.greatest("_a", F.col("_done") + 1)).filter("_a <= _b")
    return rest.select(F.explode(F.sequence("_a", "_b")).alias(name))


def region_scan(df: DataFrame, regions: DataFrame, chrom: str = "chr", pos: str = "pos", width: int = BIN) -> DataFrame:
    """Rows with canonical flag YES whose position lies in a region [lo, hi]; each row once."""
    rows = df.filter(F.col("canonical") == "YES")
    there = regions.select(F.col(chrom), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    hits = points_in(rows.select(chrom, pos).distinct(), there, [chrom], pos, "_lo", "_hi", F.col(pos).between(F.col("_lo"), F.col("_hi")), width)
    return rows.join(hits.select(chrom, pos).distinct(), [chrom, pos], "left_semi")
