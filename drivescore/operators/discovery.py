"""How completely a group's mutations are discovered: downsampling, saturation curve, index.

Rows are (keys, sample, site): a mutated site seen in a sample. Samples of a group are ranked by a hash in
each replicate; a site is seen in the first k samples exactly if the least rank of its samples is k or less,
so one minimum per site and replicate replaces all draws.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivescore.functions.variants import hash_uniform
from drivescore.operators.boosting import spread
from drivescore.operators.splits import bucket_number, numbered
from drivescore.sources.tables import written

GRID = 20
REPLICATES = 100


def downsample_curve(df: DataFrame, samples: DataFrame, keys: list[str], sample: str, site: list[str], replicates: int = REPLICATES, grid: int = GRID, seed: int = 1) -> DataFrame:
    """(keys, replicate, point, x, n_unique): sites seen in the first floor(x) samples, x on a grid of 0 to N.

    ``samples`` has one row for each of the group's samples, with or without a mutation; repeats count apart.
    """
    counted = samples.groupBy(*keys, sample).agg(F.count("*").alias("_many"))
    units = written(counted.select(*keys, sample, F.explode(F.sequence(F.lit(1), F.col("_many").cast("int"))).alias("_copy")), "units")
    sizes = units.groupBy(*keys).agg(F.count("*").cast("int").alias("n_samples"))
    # A unit is few bytes, so that few files hold many: they are dealt over the tasks before they become a row for each replicate.
    reps = spread(units, *keys, sample, "_copy").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = hash_uniform(F.col(sample), F.col("_copy"), F.col("replicate"), F.lit(seed))
    placed = numbered(reps.withColumn("_u", u), [*keys, "replicate"], "_u", [sample, "_copy"], "_rank", bucket_number(units, keys))
    # A sample's ranks travel as one row, and meet its sites once; repeats of a sample go out with the least rank of a site.
    ranks = placed.groupBy(sample, *keys).agg(F.collect_list(F.struct("replicate", "_rank")).alias("_ranks"))
    seen = df.select(sample, *keys, *site).distinct()
    met = seen.join(ranks, [sample, *keys]).select(*keys, *site, F.explode("_ranks").alias("_r")).select(*keys, *site, "_r.*")
    first = met.groupBy(*keys, "replicate", *site).agg(F.min("_rank").alias("_first"))
    by_rank = first.groupBy(*keys, "replicate", "_first").agg(F.count("*").alias("_c"))
    points = sizes.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("x", F.col("point") * F.col("n_samples") / (grid - 1)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # Each rank counts at the first grid point that reaches it; a running sum over points does the rest.
    upto = W.partitionBy(*keys, "replicate").orderBy("point").rowsBetween(W.unboundedPreceding, 0)
    at = by_rank.join(sizes, keys).withColumn("point", F.ceil(F.col("_first") * (grid - 1) / F.col("n_samples")).cast("int"))
    # floor(x) >= rank exactly if x >= rank, so that the point is ceil(rank (grid - 1) / N) up to rounding of x.
    fixed = F.when(F.floor(F.col("point") * F.col("n_samples") / (grid - 1)) < F.col("_first"), F.col("point") + 1).otherwise(F.col("point"))
    new = at.withColumn("point", fixed).groupBy(*keys, "replicate", "point").agg(F.sum("_c").alias("_new"))
    full = points.join(new, [*keys, "replicate", "point"], "left")
    return full.withColumn("n_unique", F.sum(F.coalesce("_new", F.lit(0))).over(upto)).select(*keys, "replicate", "point", "x", "n_samples", "n_unique")


def bootstrap_curves(curves: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Per replicate and grid point one of the replicates' counts, chosen by hash."""
    lists = curves.groupBy(*keys, "point", "x", "n_samples").agg(F.sort_array(F.collect_list(F.struct("replicate", "n_unique"))).alias("_l"))
    reps = lists.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = hash_uniform(*[F.col(k) for k in keys], F.col("replicate"), F.col("point"), F.lit(seed), F.lit("boot"))
    chosen = F.element_at("_l", (F.floor(u * F.size("_l")) + 1).cast("int"))
    return reps.select(*keys, "replicate", "point", "x", "n_samples", chosen["n_unique"].alias("n_unique"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fit_saturation_curve(curves: DataFrame, keys: list[str], starts: int = 24, steps: int = 40, low: float = 1e-7, high: float = 10.0) -> DataFrame:
    """(keys, replicate, m, lam, sse): the m and lam of least weighted squares of m (1 - exp(-lam x)), lam between the bounds and m at least half
    of the group's largest count.

    Weights are those of the spread of counts at a grid point: 1 / (1 + sd ** (2 log10(points))). For each lam
    the best m follows from sums over the points, so steps are on log lam alone: Gauss-Newton steps with m projected out, from the best of ``starts``
    values of even ratio, and a quarter as long after a step that would not lower the sum. A replicate's points, as many as the grid has, are one row.
    """
    spread = curves.groupBy(*keys, "point").agg(F.stddev_pop("n_unique").alias("_sd"))
    tops = curves.groupBy(*keys).agg((F.max("n_unique") / 2).alias("_half"))
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("n_unique").cast("double").alias("y"), F.col("_sd").alias("sd"))
    rows = curves.join(spread, [*keys, "point"]).filter("n_samples > 0").groupBy(*keys, "replicate").agg(F.sort_array(F.collect_list(point)).alias("_p"))
    weigh = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (1 / (1 + F.pow(p["sd"], 2 * F.log10(F.size("_p"))))).alias("w"))
    rows = rows.join(tops, keys).filter("_half > 0").withColumn("_p", F.transform("_p", weigh))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("yg", "gg", "yy", "gd", "dd", "yd")])

    def sums(theta: Column) -> Column:
        """Weighted sums of the curve g of m = 1, its derivative d by log lam, and y."""

        def add(acc: Column, p: Column) -> Column:
            def with_gd(v: Column) -> Column:
                g, d, y, w = v["g"], v["d"], p["y"], p["w"]
                parts = {"yg": y * g, "gg": g * g, "yy": y * y, "gd": g * d, "dd": d * d, "yd": y * d}
                return F.struct(*[(acc[n] + w * x).alias(n) for n, x in parts.items()])

            z = F.exp(theta) * p["x"]
            return _let(F.struct((1 - F.exp(-z)).alias("g"), (z * F.exp(-z)).alias("d")), with_gd)

        return F.aggregate("_p", zero, add)

    def at(theta: Column) -> Column:
        """theta with m, the squared error, and the step from there."""

        def solved(s: Column) -> Column:
            free = F.coalesce(F.try_divide(s["yg"], s["gg"]), F.lit(0.0))

            def stepped(m: Column) -> Column:
                slope = m * (s["yd"] - m * s["gd"])
                own = m * m * s["dd"]
                bend = F.when(m > F.col("_half"), own - F.coalesce(F.try_divide(F.pow(m * s["gd"], F.lit(2.0)), s["gg"]), F.lit(0.0))).otherwise(own)
                move = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(slope, bend), F.lit(0.0))))
                return F.struct((s["yy"] - 2 * m * s["yg"] + m * m * s["gg"]).alias("sse"), theta.alias("theta"), m.alias("m"), move.alias("move"))

            return _let(F.greatest(F.col("_half"), free), stepped)

        return _let(sums(theta), solved)

    def step(acc: Column, _: Column) -> Column:
        tried = F.greatest(F.lit(log(low)), F.least(F.lit(log(high)), acc["at"]["theta"] + acc["size"] * acc["at"]["move"]))
        better = lambda new: F.when(new["sse"] < acc["at"]["sse"], F.struct(new.alias("at"), F.lit(1.0).alias("size"))).otherwise(F.struct(acc["at"].alias("at"), (acc["size"] / 4).alias("size")))
        return _let(_let(tried, at), better)

    ratio = (log(high) - log(low)) / (starts - 1)
    first = F.array_min(F.transform(F.array(*[F.lit(log(low) + k * ratio) for k in range(starts)]), at))
    fitted = rows.withColumn("_first", F.struct(first.alias("at"), F.lit(1.0).alias("size")))
    fitted = fitted.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("_first"), step, lambda acc: acc["at"]))
    return fitted.select(*keys, "replicate", F.col("_f.m").alias("m"), F.exp("_f.theta").alias("lam"), F.col("_f.sse").alias("sse"))


def discovery_index(fits: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_samples, discovery_index, discovery_high, discovery_low): quartiles of 1 - exp(-lam N) over replicates."""
    value = F.least(F.lit(1.0), 1 - F.exp(-F.col("lam") * F.col("n_samples")))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = fits.join(sizes, keys).groupBy(*keys, "n_samples").agg(q.alias("_q"))
    return out.select(*keys, "n_samples", F.col("_q")[1].alias("discovery_index"), F.col("_q")[2].alias("discovery_high"), F.col("_q")[0].alias("discovery_low"))


def discovery_table(index: DataFrame, curves: DataFrame, mutations: DataFrame, keys: list[str]) -> DataFrame:
    """``index`` with n_muts (of ``mutations``: keys, n_muts) and n_unique_muts, the curves' value with all samples."""
    last = curves.groupBy(*keys).agg(F.max("n_unique").alias("n_unique_muts"))
    return index.join(mutations.select(*keys, "n_muts"), keys, "left").na.fill(0, ["n_muts"]).join(last, keys)


def fitted_curve_points(fits: DataFrame, sizes: DataFrame, keys: list[str], points: int = 50) -> DataFrame:
    """(keys, point, x, y): mean of the replicates' curves at equal steps of 0 to N."""
    rows = fits.join(sizes, keys).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("point") * F.col("n_samples") / (points - 1))
    return rows.groupBy(*keys, "point", "x").agg(F.avg(F.col("m") * (1 - F.exp(-F.col("lam") * F.col("x")))).alias("y"))


def count_mutations(df: DataFrame, nodes: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(node, gene, n_muts): rows with a sample under each tree node. ``nodes`` has (node, cohort).

    Rows are counted by cohort and gene first, so the tree multiplies counts and not rows.
    """
    per = df.groupBy("cohort", "gene").agg(F.count(sample).alias("n"))
    return per.join(nodes, "cohort").groupBy("node", "gene").agg(F.sum("n").alias("n_muts"))


def count_unique_mutations(df: DataFrame, keys: list[str], site: tuple[str, ...] = ("chr", "pos", "alt"), impact: str = "impact") -> DataFrame:
    return df.filter(F.col(impact) != "Synonymous").select(*keys, *site).distinct().groupBy(*keys).agg(F.count("*").alias("n_unique_muts"))
