"""Exact deduplication by a tree merge of sorted digest runs. DataFrame functions only.

Every document becomes a digest row. Rows are dealt into runs by a hash of their number; a run's equal digests become
one row with the best identifier and the count. Partitions then exchange runs in binomial rounds: in a
round, each run is cut by the next bits of its digests into ``FAN`` parts, one for each of the ``FAN`` runs whose numbers
differ in those bits alone, and every run merges the sorted parts that it gets, keeping of equal digests the best identifier
and the sum of counts. After the last round a run's number is the digests' leading bits, so that
each digest has met all its copies, and no run has gathered more than its share. Results go back down to the runs and from there to
the documents. No task holds more of a group of copies than one run of it, and the number of runs grows with
the rows.

Equality is verified at every level by two independent digests of the normalised text (SHA-256
and XXH64) and its length, all of which are part of the merge key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged

WHITE_SPACE = r"[\x20\x09-\x0D]+"
KEY = ["digest", "check", "n_norm"]
BITS = 4
FAN = 1 << BITS
RUN_ROWS = 65_536


def run_bits(rows: int) -> int:
    """Bits of a run's number: at least 8, and so many that a run has about ``RUN_ROWS`` rows; a multiple of ``BITS``."""
    bits = 8
    while bits < 28 and rows >> bits > RUN_ROWS:
        bits += BITS
    return bits


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_text, digest (SHA-256), check (XXH64), n_norm, and h (XXH64 of the whole text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("t"))
        .select("id", F.length("t").alias("n_text"), F.xxhash64("t").alias("h"), F.regexp_replace("t", WHITE_SPACE, "").alias("norm"))
        .select(
            "id",
            "n_text",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.xxhash64("norm").alias("check"),
            F.length("norm").alias("n_norm"),
            "h",
        )
    )


def merge_runs(level: DataFrame, bits: int) -> DataFrame:
    """Binomial rounds over rows of KEY, run, best (struct: n_text, not_id, not_run, not_h) and n: one row per digest.

    A round gives ``BITS`` bits of the run's number the values of the digest's. Rows move between runs that differ in those
    bits alone; within its partition a run is sorted, and equal digests of its parts merge.
    """
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    for at in range(0, bits, BITS):
        mask = (FAN - 1) << at
        moved = level.withColumn("run", F.col("run").bitwiseAND(F.lit((1 << bits) - 1 - mask).cast("long")).bitwiseOR(lead.bitwiseAND(F.lit(mask).cast("long"))))
        level = moved.repartition("run").sortWithinPartitions("run", *KEY).groupBy("run", *KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return level.drop("run")


def decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digest rows with top (the best row's struct), group_size and kept."""
    # The row number is fixed once written: it deals repeated rows over the runs as well.
    rows = staged(digest_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    bits = run_bits(rows.count())
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row", F.lit("run")), F.lit(1 << bits)))
    within = W.partitionBy("run", *KEY).orderBy(F.desc("n_text"), F.asc_nulls_last("id"), F.desc("h"))
    ranked = rows.withColumn("place", F.row_number().over(within))
    best = F.struct("n_text", F.bitwise_not("id").alias("not_id"), F.col("h"), F.bitwise_not("run").alias("not_run"))
    first = rows.groupBy("run", *KEY).agg(F.max(best).alias("best"), F.count("*").alias("n"))
    root = merge_runs(first, bits).select(*KEY, F.col("best").alias("top"), F.col("n").alias("group_size"))
    down = first.select("run", *KEY).join(root, KEY)
    kept = (F.col("place") == 1) & (F.col("run") == F.bitwise_not("top.not_run"))
    return ranked.join(down, ["run", *KEY]).withColumn("kept", kept)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. Ids are of an integer type.

    Texts are equal when they are identical without white space (space, U+0009 to U+000D). A null
    text counts as empty. The row with the most code points stays, then the smallest id; a null id
    comes after all others. Of rows that agree in all of this (repeated rows) exactly one has
    ``kept``. An empty table gives no rows. Other columns are ignored.
    """
    return decided(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.bitwise_not("top.not_id").alias("keep_id"),
        F.col("group_size"),
        F.col("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one for each group of equal texts.

    Which one: as in ``exact_dedup``. Rows are told apart by id and whole text, so an id that repeats over other texts or is null
    harms none of them; of repeated rows one stays. An empty table gives no rows.
    """
    keys = ["__id", "__none", "__h"]
    kept = decided(docs, id_col, text_col).filter("kept").select(F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__none"), F.col("h").alias("__h"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col), F.lit(0)), "__none": F.col(id_col).isNull(), "__h": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    # Join and window share one exchange of the rows.
    one = W.partitionBy(*keys).orderBy(F.lit(1))
    return keyed.join(kept, keys, "left_semi").withColumn("__one", F.row_number().over(one)).filter("__one = 1").select(*docs.columns)


ORACLE_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as n_text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
k as (
  select *, row_number() over (partition by text_sha256 order by n_text desc, doc_id asc nulls last) as place,
         count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by n_text desc, doc_id asc nulls last) as keep_id
  from n)
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from k
"""


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
