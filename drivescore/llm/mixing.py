"""Mixing sources to target weights. DataFrame functions only.

The words of each source form one stream, in the order of a hash bucket and the document id, which
is cut into blocks of a fixed length. The output is a sequence of shards of ``shard_slots`` slots.
Each shard draws its multinomial source counts: every slot takes the source in whose share of the
unit interval its hash falls. Counts are then summed along the shards, which numbers the slots of
each source; what a source drew beyond its quota is given back and what it lacks goes to closing
shards, so quotas hold exactly. Slot ``j`` of a source of ``n`` blocks takes the block at place
``j % n`` of that source's pseudorandom permutation for pass ``j div n``, a swap-or-not network
(Hoang, Morris, Rogaway 2012), which is a bijection of [0, n) for every n. A join on
(source, block) brings the slots to the documents.

No step gathers a source: its rows are dealt over hash buckets, its slots over shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import before, bucket_count, staged

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240
ROUNDS = 20
CELLS = 1024
MOST = 3
SHARD_CELL = 4096
TASK_SLOTS = 65_536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: DataFrame, block_words: int = 64, least_blocks: int = 1000) -> DataFrame:
    """Targets of the sources (``source``, ``source_size``): one row for each source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... of the sum of all sizes. A target stops
    at 3 times its source's size and the excess goes to the others by weight: target =
    min(3 size, level * weight), where the level is the largest of those that follow from taking
    the k sources of smallest 3 size / weight as full. The table has one row for each source.
    """
    everything = W.partitionBy()
    named = W.orderBy(F.asc_nulls_last("source"))
    filling = W.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    cap = F.col("source_size") * MOST
    return (
        sizes.withColumn("src", F.row_number().over(named).cast("long"))
        .withColumn("weight", ((F.col("src") - 1) % 3 + 1).cast("double"))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("heavy", F.sum("weight").over(everything))
        .withColumn("full", F.coalesce(F.sum(cap).over(filling), F.lit(0)))
        .withColumn("full_w", F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
        .withColumn("level", F.max((F.col("total") - F.col("full")) / (F.col("heavy") - F.col("full_w"))).over(everything))
        .withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight")))
        # A block has block_words words; a source of fewer than least_blocks such blocks has shorter ones.
        .withColumn("length", F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("source_size") / least_blocks))).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
        .withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.col("blocks") * MOST, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("lo", F.coalesce(F.sum("quota").over(named.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
        .select("src", "source", "source_size", "target", "length", "blocks", "quota", "lo", F.sum("quota").over(everything).cast("long").alias("slots"))
    )


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """Image of ``i`` under the pseudorandom permutation of [0, n) that ``key`` names."""

    def swap_or_not(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, n, *key), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), r, *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, swap_or_not)


def numbered_slots(counts: DataFrame) -> DataFrame:
    """``counts`` (shard, src, c) with first: the sum of c over the source's shards before. A source's shards are summed
    by cells of ``SHARD_CELL`` first, so that none of its windows grows with the mix but that over the cells."""
    celled = counts.withColumn("cell", F.expr(f"shard div {SHARD_CELL}"))
    cells = celled.groupBy("src", "cell").agg(F.sum("c").alias("sum")).withColumn("base", before(F.col("sum"), ["src"], [F.col("cell")])).drop("sum")
    own = celled.withColumn("own", before(F.col("c"), ["src", "cell"], [F.col("shard")]))
    return own.join(cells, ["src", "cell"]).select("shard", "src", "c", (F.col("own") + F.col("base")).alias("first"))


def draw_runs(sources: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, src, first, n): slots ``first`` to ``first + n - 1`` of a source lie in a shard.

    ``slots`` is the number of all slots. The draw of slot i depends on i and the seed alone.
    """
    spark = sources.sparkSession
    width = max(1, -(-slots // CELLS))
    live = sources.filter("quota > 0")
    cells = live.select("src", "lo", (F.col("lo") + F.col("quota")).alias("hi"), F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(lo + quota - 1) div {width}"))).alias("cell"))
    drawn = spark.range(slots).select(
        F.expr(f"id div {shard_slots}").alias("shard"),
        F.floor(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(1 << 53)) * F.lit(float(slots))).alias("at"),
    ).withColumn("cell", F.expr(f"at div {width}"))
    counts = drawn.join(cells, "cell").filter("at >= lo and at < hi").groupBy("shard", "src").agg(F.count("*").alias("c"))
    numbered = staged(numbered_slots(counts), "draws")
    quota = live.select("src", "quota")
    held = numbered.join(quota, "src").withColumn("n", F.least(F.col("c"), F.col("quota") - F.col("first"))).filter("n > 0").select("shard", "src", "first", "n")
    got = held.groupBy("src").agg(F.sum("n").alias("got"))
    lacking = quota.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
    closing = lacking.select("src", "quota", F.explode(F.sequence(F.col("got"), F.col("quota") - 1, F.lit(shard_slots).cast("long"))).alias("first")).select(
        F.expr(f"{-(-slots // shard_slots)} + first div {shard_slots}").cast("long").alias("shard"), "src", "first", F.least(F.lit(shard_slots).cast("long"), F.col("quota") - F.col("first")).alias("n")
    )
    return held.unionByName(closing)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, source.

    ``taken`` counts the words of the document that the mix takes, repeats counted: at most 3 times
    its size, since no block is taken more than 3 times. A null text has size 0, and so nothing is
    taken of it; null is a source of its own, the last. Repeated rows each take part. The result is
    the same in every run. An empty table gives no rows. ``keep`` names more columns to carry.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    sized = staged(sized, "sizes")
    buckets = bucket_count(sized.count())
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)).cast("int"))
    sums = staged(dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket_sums")
    sources = staged(shares(sums.groupBy("source").agg(F.sum("words").alias("source_size")), block_words), "sources")
    slots = (sources.agg(F.max("slots")).first()[0] or 0)
    bases = sums.withColumn("base", before(F.col("words"), ["source"], [F.col("bucket")])).join(
        sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))
    ).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "base", "src", "source_size", "target", "length")
    placed = (
        dealt.withColumn("ahead", before(F.col("size"), ["source", "bucket"], [F.asc_nulls_last("id"), F.col("size")]))
        .withColumn("place", F.row_number().over(W.partitionBy("source", "bucket").orderBy(F.asc_nulls_last("id"), F.col("size"))))
        .join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("start", F.col("base") + F.col("ahead"))
        .drop("b_source", "b_bucket", "base", "ahead")
    )
    placed = staged(placed, "placed")
    # Runs are small but grow to all slots: they are dealt by number, as their bytes tell nothing of that.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slots // TASK_SLOTS))
    runs = draw_runs(sources, slots, shard_slots, seed).repartition(tasks, "shard", "src")
    taken = (
        runs.select("src", F.explode(F.expr("sequence(first, first + n - 1)")).alias("j"))
        .join(sources.select("src", "blocks"), "src")
        .select("src", permuted(F.expr("j % blocks"), F.col("blocks"), F.lit(seed), F.col("src"), F.expr("j div blocks")).alias("block"))
        .groupBy("src", "block")
        .agg(F.count("*").alias("copies"))
    )
    pieces = placed.filter("size > 0").select(
        "src", "bucket", "place", "start", "size", "length",
        F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")).alias("block"),
    )
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest(F.col("start"), F.col("block") * F.col("length"))
    took = pieces.join(taken, ["src", "block"]).groupBy("src", "bucket", "place").agg(F.sum(words * F.col("copies")).alias("taken"))
    return placed.join(took, ["src", "bucket", "place"], "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("source").alias(source_col), *[F.col(f"keep_{c}").alias(c) for c in keep],
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` repeated as the mix takes them: each row taken / size times, at most 3.

    The fraction is rounded up or down by a hash of the row's id, so that sums keep near the targets.
    Rows without words are left out, as the mix takes nothing of them. The columns are those of ``docs``.
    """
    mixed = mix_sources(docs, id_col, text_col, source_col, seed=seed).select(F.col(id_col).alias("__m_id"), F.col(source_col).alias("__m_source"), F.col("size").alias("__m_size"), "taken")
    ratio = F.col("taken") / F.col("__m_size")
    u = F.shiftrightunsigned(F.xxhash64("__m_id", F.lit(seed), F.lit("round")), 11) / F.lit(float(1 << 53))
    copies = mixed.filter("__m_size > 0").withColumn("__copies", F.floor(ratio + u).cast("int"))
    # Repeated rows share an id, source and size: each of them takes the mean of their copies.
    copies = copies.groupBy("__m_id", "__m_source", "__m_size").agg(F.round(F.avg("__copies")).cast("int").alias("__copies")).filter("__copies > 0")
    same = F.col(id_col).eqNullSafe(F.col("__m_id")) & F.col(source_col).eqNullSafe(F.col("__m_source")) & (n_words(F.col(text_col)) == F.col("__m_size"))
    return docs.join(copies, same).withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
