"""Codon tables and vectors behind the blueprint figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def codon_summary(df: DataFrame, keys: list[str], score: str, hit: str, maxima: list[str], mean: str, flags: list[str], order: str) -> DataFrame:
    """(keys, scores, any class, maxima, mean, flag lists) of distinct rows; lists go by ``order``."""
    rows = df.distinct()
    entries = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(score).alias("_s"), *[F.col(f) for f in flags])))
    g = rows.groupBy(*keys).agg(entries.alias("_e"), F.bool_or(hit).alias(hit), *[F.max(m).alias(m) for m in maxima], F.avg(mean).alias(mean))
    lists = [F.transform("_e", lambda x: x["_s"]).alias("scores")]
    for f in flags:
        lists.append(F.col("_e")[f].alias(f))
    return g.select(*keys, hit, *maxima, mean, *lists)


def observed_counts(df: DataFrame, keys: list[str], sample: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(sample).alias("n_samples"))


def codon_bands(df: DataFrame, keys: list[str], missense: str, nonsense: str, scores: str = "scores") -> DataFrame:
    """Per codon: scores above 0.5, and flagged scores of 0.9 or more and of 0.5 to 0.9, by class."""

    def many(flag: str | None, low: float, high: float | None):
        values = F.col(scores) if flag is None else F.zip_with(scores, flag, lambda s, f: s * f)
        if flag is None:
            return F.size(F.filter(values, lambda v: v > low))
        return F.size(F.filter(values, lambda v: (v >= low) & (v < high) if high else v >= low))

    out = {"n_high": many(None, 0.5, None)}
    for name, flag in (("missense", missense), ("nonsense", nonsense)):
        out |= {f"{name}_top": many(flag, 0.9, None), f"{name}_mid": many(flag, 0.5, 0.9)}
    return df.select(*keys, *[c.alias(n) for n, c in out.items()])


def saturation_vectors(df: DataFrame, keys: list[str], position: str, hit: str) -> DataFrame:
    """(keys, vector): the maximum class of each position, by rank of the position."""
    per = df.groupBy(*keys, position).agg(F.max(hit).alias("_h"))
    entries = F.sort_array(F.collect_list(F.struct(position, "_h")))
    return per.groupBy(*keys).agg(entries.alias("_e")).select(*keys, F.col("_e._h").alias("vector"))


def pairwise_mcc_distance(vectors: DataFrame, gene: str = "gene", ttype: str = "ttype", vector: str = "vector") -> DataFrame:
    """(gene, a, b, distance) of the ttypes of a gene: max(1 - mcc, 0) of their vectors padded with 0.

    mcc is generalised to values of 0 to 1 by products: tp = sum(x y), and so on; 0 for a zero denominator.
    """
    a = vectors.select(F.col(gene), F.col(ttype).alias("a"), F.col(vector).alias("_x"))
    b = vectors.select(F.col(gene), F.col(ttype).alias("b"), F.col(vector).alias("_y"))

    def total(v):
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))

    pairs = a.join(b, gene).filter("a < b")
    n = F.greatest(F.size("_x"), F.size("_y")).cast("double")
    dot = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.withColumn("_n", n).withColumn("_tp", dot).withColumn("_sx", total("_x")).withColumn("_sy", total("_y"))
    fp, fn = F.col("_sx") - F.col("_tp"), F.col("_sy") - F.col("_tp")
    tn = F.col("_n") - F.col("_sx") - F.col("_sy") + F.col("_tp")
    root = F.sqrt(F.col("_sx") * F.col("_sy") * (tn + fp) * (tn + fn))
    mcc = F.coalesce(F.try_divide(F.col("_tp") * tn - fp * fn, root), F.lit(0.0))
    return pairs.select(gene, "a", "b", F.greatest(1 - mcc, F.lit(0.0)).alias("distance"))


def sum_rate_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, idx, value): element-wise sums of vectors."""
    return df.select(*keys, F.posexplode(vector).alias("idx", "_v")).groupBy(*keys, "idx").agg(F.sum(F.col("_v").cast("double")).alias("value"))
