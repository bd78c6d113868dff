"""Cluster tables: packed text to rows, significance filters, groups by tumor type, cohort selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivescore.functions.variants import excess, normalize_chrom
from drivescore.sources.tables import required

# The impact classes and the selection estimate of each.
IMPACT_ESTIMATES = {"Missense": "wmis", "Nonsense": "wnon", "Essential_Splice": "wspl"}


def filter_significant(df: DataFrame, p: str, threshold: float = 0.05) -> DataFrame:
    return df.filter(F.col(p) <= threshold)


def filter_enriched_regions(df: DataFrame, q: str, observed: str, simulated: str, threshold: float = 0.1) -> DataFrame:
    return df.filter((F.col(q) < threshold) & (F.try_divide(F.col(observed), F.col(simulated)) > 1))


def explode_packed_intervals(df: DataFrame, packed: str, keys: list[str]) -> DataFrame:
    """(keys, lo, hi) of texts such as '10,20;30,45'; rows are made distinct before, not after."""
    one = df.select(*keys, packed).distinct().withColumn("_i", F.explode(F.split(packed, ";")))
    parts = F.split("_i", ",")
    return one.select(*keys, parts[0].cast("int").alias("lo"), parts[1].cast("int").alias("hi"))


def explode_csv_list(df: DataFrame, values: str, keys: list[str], chrom: str | None = None, name: str = "pos") -> DataFrame:
    """(keys, value) of comma lists of integers, spaces apart; the chromosome without chr."""
    one = df.select(*keys, values).distinct().withColumn(name, F.explode(F.split(values, ",")))
    if chrom:
        one = one.withColumn(chrom, normalize_chrom(F.col(chrom)))
    return one.select(*keys, F.trim(name).cast("int").alias(name))


def significant_regions_semi(regions: DataFrame, significant: DataFrame, element: str = "element", keys: tuple[str, ...] = ()) -> DataFrame:
    """Regions whose element is significant; none, with the same columns, if no element is."""
    return regions.join(significant.select(element, *keys).distinct(), [element, *keys], "left_semi")


def union_groups(parts: list[tuple[str, DataFrame]], name: str = "CANCER_TYPE") -> DataFrame:
    """Tables under one another with the label of each."""
    first, *rest = [df.withColumn(name, F.lit(label)) for label, df in parts]
    for df in rest:
        first = first.unionByName(df)
    return first


def explode_samples(df: DataFrame, cohort: str = "cohort", donors: str = "donors", hypermutators: str = "hypermutators") -> DataFrame:
    """(cohort, sample): samples of all donors, and the hypermutators; repeats stay. ``df`` is read once."""
    lists = F.concat(F.coalesce(F.map_values(donors), F.array().cast("array<array<string>>")), F.array(hypermutators))
    return df.select(cohort, F.explode(lists).alias("_s")).select(cohort, F.explode("_s").alias("sample"))


def explode_samples_stats(df: DataFrame, counts: str, cohort: str = "cohort") -> DataFrame:
    """(cohort, sample) from the keys of a map of counts by sample."""
    return df.select(cohort, F.explode(F.map_keys(counts)).alias("sample"))


def attach_ttypes(samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sample) for every tree node that contains the sample's cohort; repeats stay."""
    return samples.join(nodes, "cohort").select("node", "sample")


def driver_snvs(df: DataFrame, drivers: DataFrame, gene: str = "gene", impact: str = "impact") -> DataFrame:
    """Single-base changes of driver genes."""
    return df.filter(F.col(impact) != "no-SNV").join(drivers.select(gene).distinct(), gene, "left_semi")


def filter_driver_snvs(df: DataFrame, drivers: DataFrame, gene: str = "gene", impact: str = "impact") -> DataFrame:
    """Single-base changes of driver genes; an error if there is none."""
    return required(driver_snvs(df, drivers, gene, impact), "mutations of driver genes")


def filter_by_excess(df: DataFrame, estimates: DataFrame, threshold: float = 0.85, gene: str = "gene", impact: str = "impact") -> DataFrame:
    """Rows whose impact class shows an excess above the threshold in their gene.

    Rows with a NULL in any column, of theirs or of the gene's estimates, drop; other impacts do not pass.
    """
    joined = df.join(estimates, gene).na.drop("any")
    hit = F.lit(False)
    for name, w in IMPACT_ESTIMATES.items():
        hit = hit | ((F.col(impact) == name) & (excess(F.col(w)) > threshold))
    return joined.filter(hit).select(*df.columns)
