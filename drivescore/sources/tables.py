"""Readers and writers of the tables that the scoring pipeline exchanges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from drivescore.functions.variants import normalize_chrom

# Fixed names: the columns of a variant annotation table, in order.
VEP_COLUMNS = [
    "CHR", "POS", "REF", "ALT", "GENE", "ENST", "TYPE", "CNSQ", "cDNA_POS", "CDS_POS", "PROT_POS", "AA", "CODONS", "EXISTING_VARIATION", "IMPACT", "DISTANCE", "STRAND", "FLAGS", "SYMBOL",
    "SYMBOL_SOURCE", "HGNC_ID", "CANONICAL", "MANE_SELECT", "MANE_PLUS_CLINICAL", "ENSP", "EXON", "INTRON",
]
# Fixed names: chromosomes that annotation tables number, and their usual names.
CHROM_NAMES = {"23": "X", "24": "Y", "MT": "M"}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tab-separated text with a header row, plain or gzip, under a declared schema; '' and NaN read as such."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_positional(spark: SparkSession, path: str, names: list[str | None], header: bool = False) -> DataFrame:
    """Text columns by position; ``None`` names are left out. A header row, if there is one, is dropped."""
    schema = T.StructType([T.StructField(n or f"_skip{k}", T.StringType()) for k, n in enumerate(names)])
    return spark.read.csv(path, sep="\t", header=header, schema=schema, enforceSchema=True).select(*[n for n in names if n])


#: The part of a file's path that is its key: the name up to its first dot.
FILE_NAME = r"([^/.]+)[^/]*$"


def file_key(pattern: str = FILE_NAME):
    """The key in the path of the row's input file, from the files' metadata: a filter on it leaves out files before they are read."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def scan_with_key(spark: SparkSession, glob: str, schema: T.StructType | str, key: str = "COHORT", pattern: str = FILE_NAME) -> DataFrame:
    """All files of a glob as one table, with the key that their paths hold; a filter on the key reads the files of that key alone."""
    return read_tsv(spark, glob, schema).withColumn(key, file_key(pattern))


def read_json_by_key(spark: SparkSession, glob: str, schema: T.StructType | str, key: str = "COHORT", pattern: str = FILE_NAME) -> DataFrame:
    """One JSON document per file, as one row per file with the key that its path holds."""
    return spark.read.schema(schema).json(glob, multiLine=True).withColumn(key, file_key(pattern))


def read_rate_map(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """(keys, context, rate) rows of a JSON map from context to rate."""
    return df.select(*keys, F.explode(F.from_json(json_col, "map<string,double>")).alias("context", "rate"))


def normalize_annotation_chrom(chrom):
    bare = normalize_chrom(chrom)
    out = bare
    for number, name in CHROM_NAMES.items():
        out = F.when(bare == number, F.lit(name)).otherwise(out)
    return out


def read_vep_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation table with its 27 columns and usual chromosome names."""
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "POS" else T.StringType()) for n in VEP_COLUMNS])
    return read_tsv(spark, path, schema).withColumn("CHR", normalize_annotation_chrom(F.col("CHR")))


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, value) rows of a per-base signal."""
    return spark.read.csv(path, sep="\t", header=False, schema="chrom string, start int, end int, value double")


def read_sequence_regions(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, seq) rows; seq has one more base on either side."""
    return spark.read.csv(path, sep="\t", header=True, schema="chr string, start int, end int, seq string")


def read_trace_skip_comments(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text that do not begin with two number signs."""
    return spark.read.text(path).filter(~F.col("value").startswith("##"))


_OWN_DIR: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which ``spark.checkpoint.dir`` names.

    Only a session in one process (tests) that names none has a temporary folder instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _OWN_DIR.setdefault("dir", tempfile.mkdtemp(prefix="spark-files-"))
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, so plans that use it often stay small. ``options`` are the Parquet writer's."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def required(df: DataFrame, what: str) -> DataFrame:
    """``df``; an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def read_saturation(df: DataFrame) -> DataFrame:
    """Saturation annotations under short names: rows of the selected transcript whose alternate is a base.

    An error if the selected transcript has no row.

    ``df`` has Chromosome, Position, Reference, Alternate, Gene, Feature, Consequence, Symbol, Mane_select.
    """
    names = {"Chromosome": "chr", "Position": "pos", "Reference": "ref", "Alternate": "alt", "Gene": "ENSEMBL_GENE", "Feature": "ENSEMBL_TRANSCRIPT", "Consequence": "csqn", "Symbol": "gene"}
    kept = required(df.filter(F.col("Mane_select") != "-"), "mutations in the selected transcript").filter(F.col("Alternate").isin("A", "C", "G", "T"))
    return kept.withColumnsRenamed(names).withColumn("chr", F.regexp_replace("chr", "chr", ""))


def foldered(df: DataFrame, keys: list[str] | None):
    """A writer of a folder for each value of the keys. Rows of a key meet in one task first (in several if they are many), else each task would
    write a file of its own to each folder."""
    return df.hint("rebalance", *[F.col(k) for k in keys]).write.partitionBy(*keys) if keys else df.write


def write_tsv(df: DataFrame, path: str, keys: list[str] | None = None, compress: bool = True) -> None:
    """Tab-separated text with a header, in a folder for each value of the keys."""
    writer = foldered(df, keys).option("sep", "\t").option("header", True)
    if compress:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    foldered(df, keys).parquet(path)


def write_json(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    foldered(df, keys).json(path)


def sort_output(df: DataFrame, *columns: str) -> DataFrame:
    """The order in which tables are handed on: by chromosome or name, then position."""
    return df.orderBy(*columns)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()


def channel_concat(*tables: DataFrame) -> DataFrame:
    """Tables one after another, by column name; repeats stay."""
    first, *rest = tables
    for df in rest:
        first = first.unionByName(df)
    return first


def vep_input(df: DataFrame, order: list[str]) -> DataFrame:
    """(chr, start, end, alleles) of the first row of each site, by chromosome and position."""
    first = W.partitionBy("chr", "pos", "ref", "alt").orderBy(*order)
    rows = df.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    return rows.select("chr", F.col("pos").alias("start"), F.col("pos").alias("end"), F.concat_ws("/", "ref", "alt").alias("alleles")).orderBy("chr", "start", "alleles")


def write_vep_input(df: DataFrame, path: str, order: list[str], gene: str | None = None) -> None:
    """The sites as text without a header; in a folder of its own for each gene if its column is named."""
    if gene is None:
        vep_input(df, order).write.option("sep", "\t").option("header", False).csv(path)
        return
    sites = df.dropDuplicates([gene, "chr", "pos", "ref", "alt"]).select(gene, "chr", F.col("pos").alias("start"), F.col("pos").alias("end"), F.concat_ws("/", "ref", "alt").alias("alleles"))
    rows = sites.repartition(gene).sortWithinPartitions(gene, "chr", "start", "alleles")
    rows.write.partitionBy(gene).option("sep", "\t").option("header", False).csv(path)
