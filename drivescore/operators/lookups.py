"""Key joins: points, annotations, flags, scores, cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivescore.functions.variants import PTMS
from drivescore.operators.tree import first_per_key

# Where the five modifications stand in a residue's flag vector.
PTM_PLACES = {"Acetylation": 0, "Methylation": 5, "Phosphorylation": 3, "Regulatory_Site": 7, "Ubiquitination": 4}


def point_membership(df: DataFrame, points: DataFrame, name: str = "level", keys: tuple[str, ...] = ("chr", "pos"), ttype: str = "ttype") -> DataFrame:
    """Add the level of the exact point: 2 if the row's own ttype has it, 1 if any has, 0 if none."""
    any_t = points.select(*keys).distinct().withColumn("_any", F.lit(1))
    own = points.select(*keys, ttype).distinct().withColumn("_own", F.lit(2))
    out = df.join(any_t, list(keys), "left").join(own, [*keys, ttype], "left")
    return out.withColumn(name, F.coalesce("_own", "_any", F.lit(0))).drop("_own", "_any")


def annotate_variant(df: DataFrame, annotations: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Add columns of the first annotation row of each key, of those with a selected transcript; NULL without one."""
    return df.join(first_annotations(annotations, keys, order, columns), keys, "left")


def first_annotations(annotations: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """(keys, columns) of the first annotation row of each key, of those with a selected transcript."""
    return first_per_key(annotations.filter("mane <> '-'"), keys, order).select(*keys, *columns)


def flag_vector_lookup(df: DataFrame, vectors: DataFrame, keys: list[str], places: dict[str, int] = PTM_PLACES, vector: str = "flags", missense_only: Column | None = None) -> DataFrame:
    """Add one 0/1 column for each place of the key's flag vector; 0 without one.

    ``missense_only``, if given, tells which rows may have flags; the others get 0.
    """
    found = df.join(vectors.select(*keys, F.col(vector).alias("_v")), keys, "left")
    ok = F.lit(True) if missense_only is None else F.coalesce(missense_only, F.lit(False))
    return found.withColumns({n: F.when(ok, F.coalesce(F.get("_v", F.lit(k)).cast("int"), F.lit(0))).otherwise(0) for n, k in places.items()}).drop("_v")


def flatten_flags(df: DataFrame, nested: str) -> DataFrame:
    """(gene, residue, flags) of a nested map gene -> residue -> flags."""
    return df.select(F.explode(nested).alias("gene", "_m")).select("gene", F.explode("_m").alias("residue", "flags"))


def anti_join_mnv(df: DataFrame, mnvs: DataFrame, keys: list[str], positions: str = "positions", pos: str = "pos") -> DataFrame:
    """Rows whose key and position are not in the list of multi-nucleotide variants (comma lists of positions)."""
    gone = mnvs.select(*keys, F.explode(F.split(positions, ",")).alias("_p")).select(*keys, F.trim("_p").try_cast("int").alias(pos)).distinct()
    # The join sorts by the position before the others: it tells most rows apart.
    return df.join(gone, [pos, *keys], "left_anti")


def cohort_to_ttype(df: DataFrame, cohorts: DataFrame, cohort: str = "cohort", ttype: str = "ttype", order: str | None = None) -> DataFrame:
    """Add the ttype of the row's cohort; an unknown cohort fails when the row is computed.

    Of a cohort's several rows the last by ``order`` counts, or without that column the last ttype by name.
    """
    named = cohorts.groupBy(cohort).agg((F.max_by(ttype, order) if order else F.max(ttype)).alias(ttype))
    out = df.join(named, cohort, "left")
    fail = F.raise_error(F.concat(F.lit("unknown cohort: "), F.coalesce(F.col(cohort), F.lit("NULL"))))
    return out.withColumn(ttype, F.when(F.col(ttype).isNull(), fail.cast("string")).otherwise(F.col(ttype)))


def channel_join(key: str, *tables: DataFrame) -> DataFrame:
    """Inner join of tables by key; keys that one of them lacks drop."""
    return reduce(lambda a, b: a.join(b, key), tables)


def join_external_scores(df: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their external scores, of those rows that have any and a selected transcript."""
    return df.join(scores.filter("mane <> '-'").drop("mane"), keys)


def join_assay_scores(df: DataFrame, assays: list[dict]) -> DataFrame:
    """Left join one score column for each assay: {table, key, on, score, name, where}."""
    for a in assays:
        table = a["table"].filter(a["where"]) if a.get("where") is not None else a["table"]
        df = df.join(table.select(F.col(a["key"]).alias(a["on"]), F.col(a["score"]).alias(a["name"])), a["on"], "left")
    return df


def annotate_cv_table(cv: DataFrame, assays: DataFrame | None, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Cross-validation rows with the assays', if there are any, and the predictors' scores; all rows stay."""
    if assays is not None:
        cv = cv.join(assays, keys, "left")
    return cv.join(scores, keys, "left")


def exclude_train_rows(test: DataFrame, train: DataFrame, keys: tuple[str, ...] = ("split", "pos", "ref", "alt")) -> DataFrame:
    """Test rows whose site is not in the training rows of the same split."""
    return test.join(train.select(*keys).distinct(), list(keys), "left_anti")


def observed_with_scores(observed: DataFrame, predictions: DataFrame, cohorts: DataFrame, keys: list[str]) -> DataFrame:
    """Observed mutations of the given cohorts that have a prediction."""
    return observed.join(cohorts.select("cohort").distinct(), "cohort", "left_semi").join(predictions.filter("class is not null"), keys)


def domains_with_names(domains: DataFrame, names: DataFrame, genes: DataFrame | None = None, domain: str = "domain", transcript: str = "transcript") -> DataFrame:
    """Domains with their distinct names (left), and with their transcripts' genes (inner) if given."""
    out = domains.join(names.distinct(), domain, "left")
    return out if genes is None else out.join(genes.distinct(), transcript)


def role_join(df: DataFrame, roles: DataFrame, gene: str = "gene") -> DataFrame:
    return df.join(roles.distinct(), gene)


def expected_rate_lookup(df: DataFrame, rates: DataFrame, keys: list[str], rate: str = "rate") -> DataFrame:
    """Add the rate of the row's key; 0 where there is none."""
    return df.join(rates.select(*keys, rate), keys, "left").na.fill(0.0, [rate])


def drop_suffix_columns(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that keeps the left column of each name that both sides have."""
    return left.join(right.select(*keys, *[c for c in right.columns if c not in left.columns]), keys, how)


assert set(PTM_PLACES) == set(PTMS)
