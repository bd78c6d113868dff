"""Ranking and classification metrics of scored rows, grouped by any keys. Labels are 0/1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivescore.operators.splits import balance_classes, same_keys, with_totals
from drivescore.sources.tables import written

CLIP = 1e-15
BORDERS = 1023


def _both_classes(label: str) -> Column:
    return (F.min(label) == 0) & (F.max(label) == 1)


def _counts(label: str, p: str, threshold: float) -> dict[str, Column]:
    hit, yes = F.col(p) >= threshold, F.col(label) == 1
    return {"tp": F.count_if(hit & yes), "fp": F.count_if(hit & ~yes), "tn": F.count_if(~hit & ~yes), "fn": F.count_if(~hit & yes)}


def confusion_counts(df: DataFrame, keys: list[str], label: str = "label", p: str = "p", threshold: float = 0.5) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(label, p, threshold).items()])


def binary_metrics(df: DataFrame, keys: list[str], label: str = "label", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, npv, recall, fscore100, fscore50, mcc, balance, calibration, size.

    A zero denominator gives NULL; mcc 0.
    """
    g = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(label, p, threshold).items()], F.avg(p).alias("_p"), F.avg(label).alias("_y"), F.count("*").alias("size"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def fbeta(b: float) -> Column:
        return F.try_divide((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)

    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))
    return g.select(
        *keys, F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tn, tn + fn).alias("npv"),
        F.try_divide(tp, tp + fn).alias("recall"), fbeta(1.0).alias("fscore100"), fbeta(0.5).alias("fscore50"), mcc.alias("mcc"),
        (0.5 - F.col("_y")).alias("balance"), F.try_divide(F.col("_p") - F.col("_y"), F.col("_y")).alias("calibration"), "size",
    )


def in_ranges(by: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Add _bucket: the place of a row's score among its key's ``BORDERS`` borders, which a quantile sketch of the rows sets.

    However the scores lie, a range holds about rows / ``BORDERS`` of a key.
    """
    shares = F.array(*[F.lit(k / (BORDERS + 1)) for k in range(1, BORDERS + 1)])
    sketch = by.groupBy(*[F.col(k).alias(f"_s_{k}") for k in keys]).agg(F.array_distinct(F.percentile_approx(F.col(p).cast("double"), shares, 20_000)).alias("_borders"))
    steps = F.array(*[F.lit(1 << k) for k in range(BORDERS.bit_length() - 1, -1, -1)])

    def further(at: Column, step: Column) -> Column:
        return F.when(at + step <= F.size("_borders"), F.when(F.get("_borders", at + step - 1) < F.col(p), at + step).otherwise(at)).otherwise(at)

    return by.join(sketch, same_keys(keys, [f"_s_{k}" for k in keys])).withColumn("_bucket", F.aggregate(steps, F.lit(0), further)).select(*by.columns, "_bucket")


def _before(by: DataFrame, keys: list[str], p: str, values: list[str], descending: bool = False) -> DataFrame:
    """Add _before_<value>: its sum over the rows of the keys whose score comes before the row's own; and _all_<value>, over all.

    ``by`` has one row per distinct score. It is written in ranges of score; whole ranges are summed first and a row adds its own range's
    part, so that a key with most of the rows is dealt over its ranges.
    """
    rows = written(in_ranges(by, keys, p), "ranges")

    def up(c: str) -> Column:
        return F.desc(c) if descending else F.asc(c)

    def so_far(w, c: str) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    named = [f"_k_{k}" for k in keys]
    sums = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
    over = W.partitionBy(*keys)
    bases = sums.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col("_bucket").alias("_b"), *[so_far(over.orderBy(up("_bucket")), v).alias(f"_base_{v}") for v in values], *[F.sum(v).over(over).alias(f"_all_{v}") for v in values])
    within = W.partitionBy(*keys, "_bucket").orderBy(up(p))
    out = rows.withColumns({f"_own_{v}": so_far(within, v) for v in values}).join(bases, same_keys([*keys, "_bucket"], [*named, "_b"]))
    out = out.withColumns({f"_before_{v}": F.col(f"_own_{v}") + F.col(f"_base_{v}") for v in values})
    return out.select(*by.columns, *[f"_before_{v}" for v in values], *[f"_all_{v}" for v in values])


def roc_auc(df: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """Area under the ROC curve by mid-ranks; NULL with one class. Equal scores meet in one row before any window."""
    by = df.groupBy(*keys, p).agg(F.count("*").alias("_n"), F.sum(label).alias("_pos"))
    ranked = _before(by, keys, p, ["_n"]).withColumn("_mid", F.col("_before__n") + (F.col("_n") + 1) / 2)
    g = ranked.groupBy(*keys).agg(F.sum(F.col("_mid") * F.col("_pos")).alias("_s"), F.sum("_pos").alias("_p1"), F.sum(F.col("_n") - F.col("_pos")).alias("_p0"))
    return g.select(*keys, F.try_divide(F.col("_s") - F.col("_p1") * (F.col("_p1") + 1) / 2, (F.col("_p1") * F.col("_p0")).cast("double")).alias("auc"))


def log_likelihood(label: Column, p: Column) -> Column:
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return F.when(label == 1, F.ln(q)).otherwise(F.ln(1 - q))


def log_loss(df: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    value = F.avg(-log_likelihood(F.col(label), F.col(p)))
    return df.groupBy(*keys).agg(F.when(_both_classes(label), value).alias("logloss"))


def deviance(df: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(-2 * log_likelihood(F.col(label), F.col(p))).alias("deviance"))


def _cumulated(df: DataFrame, keys: list[str], label: str, p: str) -> DataFrame:
    """One row per distinct score: positives and negatives at or above it, and the totals."""
    by = df.groupBy(*keys, p).agg(F.sum(label).alias("_pos"), F.count("*").alias("_n")).withColumn("_neg", F.col("_n") - F.col("_pos"))
    upto = _before(by, keys, p, ["_pos", "_neg"], descending=True)
    return upto.select(*keys, p, (F.col("_before__pos") + F.col("_pos")).alias("_tp"), (F.col("_before__neg") + F.col("_neg")).alias("_fp"), "_pos", "_neg", F.col("_all__pos").alias("_p1"), F.col("_all__neg").alias("_p0"))


def roc_points(df: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """(keys, threshold, fpr, tpr) by distinct score."""
    c = _cumulated(df, keys, label, p)
    return c.select(*keys, F.col(p).alias("threshold"), F.try_divide(F.col("_fp").cast("double"), F.col("_p0")).alias("fpr"), F.try_divide(F.col("_tp").cast("double"), F.col("_p1")).alias("tpr"))


def pr_curve(df: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """(keys, threshold, precision, recall) by distinct score."""
    c = _cumulated(df, keys, label, p)
    return c.select(*keys, F.col(p).alias("threshold"), F.try_divide(F.col("_tp").cast("double"), F.col("_tp") + F.col("_fp")).alias("precision"), F.try_divide(F.col("_tp").cast("double"), F.col("_p1")).alias("recall"))


def pr_auc(df: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """Trapezoid area under the precision-recall curve, which begins at recall 0 with precision 1."""
    c = _cumulated(df, keys, label, p)
    # The point before is what the counts were without the row's own score.
    tp, fp, tp0, fp0 = (x.cast("double") for x in (F.col("_tp"), F.col("_fp"), F.col("_tp") - F.col("_pos"), F.col("_fp") - F.col("_neg")))
    step = F.try_divide(F.col("_pos").cast("double"), F.col("_p1"))
    height = tp / (tp + fp) + F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    return c.groupBy(*keys).agg(F.sum(step * height / 2).alias("pr_auc"))


def pr_benchmark(df: DataFrame, keys: list[str], label: str, score: str, row_id: str, least_positives: int = 20, balance: bool = True, seed: int = 1) -> DataFrame:
    """PR area of a one-variable logistic fit, for keys of more than ``least_positives`` positives.

    The fit is monotone in the score and its slope has the sign of their covariance, so the area is that of
    the score times that sign; no fit is made.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    if balance:
        rows = balance_classes(rows, keys, label, row_id, seed)
    sign = F.signum(F.covar_pop(F.col(score).cast("double"), F.col(label).cast("double")))
    rows = written(rows.select(*keys, label, score), "balanced")
    rows = with_totals(rows, keys, _sign=sign, _ones=F.sum(label)).filter(F.col("_ones") > least_positives)
    return pr_auc(rows.withColumn("_s", F.col("_sign") * F.col(score)), keys, label, "_s")


def mean_fscore(df: DataFrame, keys: list[str], fscore: str = "fscore50") -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.avg(fscore), F.lit(0.5)).alias("fscore"))


def score_benchmark_table(df: DataFrame, keys: list[str], label: str, scores: list[str], row_id: str, least_positives: int = 20) -> DataFrame:
    """One row per key, one PR area per score column; NULL where it can't be computed."""
    long = df.unpivot([*keys, row_id, label], scores, "score_name", "score")
    area = pr_benchmark(long, [*keys, "score_name"], label, "score", row_id, least_positives)
    wide = area.groupBy(*keys).pivot("score_name", scores).agg(F.first("pr_auc"))
    return df.select(*keys).distinct().join(wide, keys, "left")


def evaluate_models(df: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """All metrics of each member on its own test rows: binary metrics, auc and logloss."""
    return binary_metrics(df, keys, label, p).join(roc_auc(df, keys, label, p), keys).join(log_loss(df, keys, label, p), keys)


def consensus(df: DataFrame, keys: list[str], p: str = "p", weight: str | None = None, exponent: float = 2.3) -> DataFrame:
    """sigmoid(exponent * mean of logits), weighted by 1 / ``weight`` (a log loss) if given."""
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col(p)))
    logit = F.ln(q / (1 - q))
    mean = F.avg(logit) if weight is None else F.sum(logit / F.col(weight)) / F.sum(1 / F.col(weight))
    return df.groupBy(*keys).agg((1 / (1 + F.exp(-exponent * mean))).alias("score"))


def median_iqr(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, median, high): quartiles, linear between the two nearest values; NULL values are passed over.

    Values are counted first and ranked through score buckets, so that no task holds all values of a key.
    """
    by = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    named = [f"_t_{k}" for k in keys]
    known = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]).distinct()
    ranked = _before(by, keys, value, ["_n"]).join(known, same_keys(keys, named), "right").withColumnRenamed("_all__n", "_all")
    picks = []
    for k, q in enumerate((0.25, 0.5, 0.75)):
        at = (F.col("_all") - 1) * q
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_before__n") <= place) & (place < F.col("_before__n") + F.col("_n"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}{k}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_part{k}"))
    g = ranked.groupBy(*[F.col(f"_t_{k}").alias(k) for k in keys]).agg(*picks)
    quartiles = [(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * F.col(f"_part{k}")).alias(n) for k, n in enumerate(("low", "median", "high"))]
    return g.select(*keys, *quartiles)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): rows of each key, such as a gene."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def test_summary(df: DataFrame, keys: list[str], p: str = "p", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """(keys, p, binary, label): each row's probability, its class at the threshold and its true label."""
    return df.select(*keys, p, (F.col(p) >= threshold).cast("int").alias("binary"), label)


def mean_train_size(df: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Mean number of training rows over splits, of keys that reach ``least``."""
    per = df.filter("role = 'train'").groupBy(*keys, "split").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.avg("n").alias("mean_size")).filter(F.col("mean_size") >= least)
