"""Whole tables: training rows of a cohort, saturation tables, prediction."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivescore.functions.variants import CLASSES, FEATURES, class_threshold, classify_consequence, half_precision, nmd_flag, normalize_chrom, one_hot_consequence, rectify
from drivescore.operators.boosting import spread
from drivescore.operators.clusters import driver_snvs, filter_by_excess, filter_driver_snvs
from drivescore.operators.intervals import WIDE_BIN, domains_at, occupied, region_overlap_counts, region_overlap_outer, signal_values, types_at
from drivescore.operators.lookups import PTM_PLACES, anti_join_mnv, first_annotations, flag_vector_lookup
from drivescore.operators.metrics import consensus, mean_train_size
from drivescore.operators.model import failed_groups, mean_attribution, score_members, train_ensemble, tree_attribution
from drivescore.operators.sequence import all_substitutions, drawn_counts, explode_bases, in_order, weighted_draw
from drivescore.sources.tables import required, written


def to_half_open(df: DataFrame, pos: str = "pos") -> DataFrame:
    """start = pos - 1 and end = pos in place of nothing: the position stays."""
    return df.withColumn("start", F.col(pos) - 1).withColumn("end", F.col(pos))


def union_labelled(positives: DataFrame, negatives: DataFrame, name: str = "response") -> DataFrame:
    """Both tables by column name, with 1 and 0 as response; columns that one lacks are NULL there."""
    return positives.withColumn(name, F.lit(1)).unionByName(negatives.withColumn(name, F.lit(0)), allowMissingColumns=True)


def drop_synonymous_positives(df: DataFrame, response: str = "response") -> DataFrame:
    return df.filter(~((F.col("csqn_type_synonymous") == 1) & (F.col(response) == 1)))


def keep_known_consequence(df: DataFrame, consequence: str = "csqn_type") -> DataFrame:
    """Rows of the four classes; an error if there is none."""
    return required(df.filter(F.col(consequence).isin(CLASSES)), "mutations of a known consequence")


# Joins sort by the first of these before the others: the position tells most rows apart.
SITE = ["pos", "gene", "chr", "alt"]


# Numbers by ttype are many and small: to pack their differences takes less than to keep a dictionary.
PACKED = {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}


def site_annotations(t: dict[str, DataFrame]) -> DataFrame:
    """(SITE, csqn, exon, aachange): the first annotation of each site that has one."""
    return first_annotations(t["annotations"], SITE, ["ord", "csqn"], ["csqn", "exon", "aachange"])


def site_features(sites: DataFrame, t: dict[str, DataFrame], known: bool = False) -> DataFrame:
    """What is known of distinct sites (gene, chr, pos, alt) under any ttype, beside the sites' other columns. Each table meets the sites for itself.

    Ttypes of clusters and points and the domains are arrays, bounded by the number of ttypes and of a position's domains.
    An annotation belongs to its gene: overlapping genes have one each. With ``known``, sites of no known class are left out. ``t`` may have
    the table of ``site_annotations`` under that name.
    """
    out = sites.join(t["site_annotations"] if "site_annotations" in t else site_annotations(t), SITE, "left")
    out = out.withColumn("csqn_type", classify_consequence(F.col("csqn"))).withColumn("nmd", nmd_flag(F.col("exon")))
    if known:
        out = out.filter(F.col("csqn_type").isin(CLASSES))
    out = out.withColumn("residue", F.expr("substring(aachange, 1, length(aachange) - 1)"))
    out = flag_vector_lookup(out, t["flags"], ["residue", "gene"]).drop("residue", "csqn", "exon")
    out = out.join(signal_values(sites, t["signal"], "PhyloP"), ["pos", "chr"], "left").withColumn("PhyloP", half_precision(F.col("PhyloP")))
    out = out.join(types_at(sites, t["clusters"], "_clusters"), ["pos", "chr"], "left")
    out = out.join(t["points"].groupBy("chr", "pos").agg(F.collect_set("ttype").alias("_points")), ["pos", "chr"], "left")
    return out.join(domains_at(sites, t["domains"], "_domains"), ["pos", "gene"], "left")


def add_features(df: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """All feature columns of rows with (ttype, gene, chr, pos, alt), found once for each distinct site and joined to the rows once.

    ``t``: annotations (gene, chr, pos, alt, mane, csqn, exon, aachange, ord), signal, flags (gene, residue, flags),
    clusters, points, domains. Levels are 2 for the row's own ttype, 1 for any, 0 for none.
    """
    return with_levels(with_sites(df, t))


def with_sites(df: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Rows with what is known of their site under any ttype."""
    sites = written(df.select(*SITE).distinct(), "sites")
    return df.join(written(site_features(sites, t), "site_features"), SITE)


def add_features_counted(df: DataFrame, t: dict[str, DataFrame], ttypes: list[str]) -> DataFrame:
    """The features of ``add_features`` for rows with drawn, an array of numbers by ttype in the order of ``ttypes``. A row stays one for all ttypes
    that no table names at its site, whose features are equal; the others have one each.

    Rows where no table has anything, by wide bins of the position, meet no table: they have the features of a site of which nothing is known.
    """
    t = t | {"site_annotations": written(site_annotations(t), "site_annotations")}
    spans = [("site_annotations", "pos", "pos"), ("signal", "start", "end"), ("clusters", "lo", "hi"), ("points", "pos", "pos"), ("domains", "start_pos", "stop_pos")]
    bins = written(occupied([(t[name], lo, hi) for name, lo, hi in spans], "_occupied"), "occupied")
    here = F.floor(F.col("pos") / WIDE_BIN).cast("long") == F.col("_occupied")
    rows = df.join(F.broadcast(bins), here, "left").withColumn("_near", F.col("_occupied").isNotNull()).drop("_occupied")
    marked = written(rows, "training_rows", **PACKED)
    # Observed rows are few bytes in few files, so rows are dealt by their site before they meet it.
    near = by_named_ttype(with_sites(spread(marked.filter("_near").drop("_near"), *SITE), t), ttypes)
    near = with_levels(near, F.col("_own")).drop("_own")
    far = marked.filter("not _near").drop("_near").na.drop("any", subset=SITE)
    zero = {**dict.fromkeys(["nmd", "CLUSTL", "HotMaps", "smRegions", *PTM_PLACES], 0), "motif": ""}
    return near.unionByName(far.withColumns({f.name: F.lit(zero.get(f.name)).cast(f.dataType) for f in near.schema if f.name not in far.columns}))


def by_named_ttype(rows: DataFrame, ttypes: list[str]) -> DataFrame:
    """A row for each ttype with a number that the tables name at the row's site, and one for all others, whose drawn has their numbers and 0 elsewhere.
    _own lists the ttype of the former, and none for the latter."""
    known = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    named = F.array_distinct(F.concat(known(F.col("_clusters")), known(F.col("_points")), known(F.col("_domains.ttype"))))
    order = F.array(*[F.lit(v).cast("string") for v in ttypes])
    places = F.filter(F.transform(named, lambda v: F.array_position(order, v).cast("int")), lambda k: (k > 0) & (F.get("drawn", k - 1) > 0))
    # 0 stands for those that are not named.
    rows = rows.withColumn("_named", F.coalesce(places, F.array().cast("array<int>"))).withColumn("_place", F.explode(F.concat(F.array(F.lit(0)), F.col("_named"))))
    own = F.transform("drawn", lambda n, k: F.when(F.when(F.col("_place") == 0, ~F.array_contains("_named", k + 1)).otherwise(F.col("_place") == k + 1), n).otherwise(0))
    plain = F.size("_named") == 0
    rows = rows.withColumn("drawn", F.when(plain, F.col("drawn")).otherwise(own)).filter(plain | (F.col("_place") > 0) | F.exists("drawn", lambda n: n > 0))
    return rows.withColumn("_own", F.when(F.col("_place") > 0, F.array(F.get(order, F.col("_place") - 1))).otherwise(F.array().cast("array<string>"))).drop("_named", "_place")


def unnested(rows: DataFrame, nested: str) -> DataFrame:
    """A row for each struct of the array ``nested``, whose fields become columns."""
    return rows.select("*", F.explode(nested).alias("_own")).select("*", "_own.*").drop("_own", nested)


def with_levels(rows: DataFrame, own: Column | None = None) -> DataFrame:
    """Levels and motif of rows with what was found at their site under any ttype. ``own`` lists the ttypes that count as the row's own."""
    own = F.array("ttype") if own is None else own

    def level(types) -> F.Column:
        return F.when(F.arrays_overlap(types, own), 2).when(F.size(types) > 0, 1).otherwise(0)

    mine = F.filter("_domains", lambda d: F.array_contains(own, d["ttype"]))
    shown = F.array_distinct(F.transform(F.when(F.size(mine) > 0, mine).otherwise(F.col("_domains")), lambda d: F.struct(d["ord"], d["element"])))
    motif = F.coalesce(F.array_join(F.transform(shown, lambda d: F.concat(d["element"], F.lit(";"))), ""), F.lit(""))
    found = {"CLUSTL": level(F.col("_clusters")), "HotMaps": level(F.col("_points")), "smRegions": level(F.col("_domains.ttype")), "motif": motif}
    return rows.withColumns(found).drop("_clusters", "_points", "_domains")


def background(t: dict[str, DataFrame], counts: DataFrame, per_row: int = 50, seed: int = 1, ttypes: list[str] | None = None) -> DataFrame:
    """(ttype, gene, chr, pos, ref, alt): mutations drawn at random from the genes' sequences.

    All changes of the bases of ``t["sequences"]`` (gene, chr, start, seq) have the rate of their context in ``t["rates"]`` (context,
    rate; 0 without one); for each (ttype, gene) of ``counts``, ``per_row`` times n of them are drawn by rate, or evenly if no
    change of the gene has a rate. With ``ttypes``, all of ``counts``, a change is one row with drawn, its numbers of draws in their order.
    """
    genes = t["sequences"].join(counts.select("gene").distinct(), "gene", "left_semi")
    changes = all_substitutions(explode_bases(genes, ["gene", "chr"]), ["gene", "chr"])
    candidates = changes.join(t["rates"].select("context", "rate"), "context", "left").na.fill(0.0, ["rate"]).drop("context")
    draw = (candidates, counts, "rate", ["gene"], ["chr", "pos", "alt"], seed, per_row, ("ttype",))
    if ttypes:
        return drawn_counts(*draw, wide=ttypes).select("gene", "chr", "pos", "ref", "alt", "drawn")
    return weighted_draw(*draw).select("ttype", "gene", "chr", "pos", "ref", "alt")


def build_training_table(t: dict[str, DataFrame], per_row: int = 50, threshold: float = 0.85, seed: int = 1, counted: bool = False) -> DataFrame:
    """Labelled feature rows: observed driver mutations of excess classes, and drawn background mutations.

    ``t``: muts (cohort, ttype, gene, chr, pos, ref, alt, sample_id, impact), drivers, mnvs, estimates, regions
    (chr, r_start, r_end, r_gene), sequences, rates and what ``add_features`` takes. With ``counted``, rows that are equal but for their ttype are one
    row with drawn, an array of their numbers by ttype; its metadata list the ttypes as JSON (background rows may be several, whose numbers add up). An error
    if no observed mutation is left.
    """
    muts = anti_join_mnv(driver_snvs(t["muts"], t["drivers"]), t["mnvs"], ["gene", "sample_id", "cohort"])
    muts = to_half_open(filter_by_excess(muts, t["estimates"], threshold))
    sites, by_key = ["gene", "chr", "pos", "ref", "alt"], lambda n: positives.groupBy("ttype", "gene").agg(n.alias("n"))
    if counted:
        # What regions make of a mutation is counted, as nothing of theirs is kept.
        rows = region_overlap_counts(written(muts.select("ttype", *sites, "start", "end"), "observed"), t["regions"], "_k")
        positives = written(rows.groupBy("ttype", *sites).agg(F.sum("_k").alias("n")), "positives")
    else:
        positives = written(region_overlap_outer(muts, t["regions"]).select("ttype", *sites), "positives")
    if positives.isEmpty():
        filter_driver_snvs(t["muts"], t["drivers"])
    required(positives, "observed mutations of excess classes")
    counts = written(by_key(F.sum("n") if counted else F.count("*")), "positive_counts")
    if not counted:
        rows = union_labelled(positives, background(t, counts, per_row, seed)).withColumn("chr", normalize_chrom(F.col("chr")))
        return rectify(drop_synonymous_positives(one_hot_consequence(add_features(written(rows, "training_rows"), t), "csqn_type")))
    ttypes = sorted((r[0] for r in counts.select("ttype").distinct().collect()), key=lambda v: (v is None, v))
    observed = positives.groupBy(*sites).agg(in_order("ttype", "n", ttypes).alias("drawn"))
    rows = union_labelled(observed, background(t, counts, per_row, seed, ttypes)).withColumn("chr", normalize_chrom(F.col("chr")))
    out = rectify(drop_synonymous_positives(one_hot_consequence(add_features_counted(rows, t, ttypes), "csqn_type")))
    return out.withColumn("drawn", F.col("drawn").alias("drawn", metadata={"ttypes": json.dumps(ttypes)}))


def annotate_saturation(saturation: DataFrame, t: dict[str, DataFrame], closure: DataFrame | None = None) -> DataFrame:
    """Feature rows of every possible change of the known classes. ``saturation`` has ttype, gene, chr, pos, ref, alt.

    With ``closure``, what is found at any ttype below the row's own counts as its own. An error if no change has a known class.

    A site's rows travel as one, so that each table is met once a site, and ttypes meet those below them once all is found.
    """
    if closure is not None:
        t = t | {k: t[k].join(closure.select(F.col("node").alias("ttype")).distinct(), "ttype", "left_semi") for k in ("clusters", "points", "domains")}
    rest = F.collect_list(F.struct(*[c for c in saturation.columns if c not in SITE])).alias("_rows")
    sites = written(saturation.groupBy(*SITE).agg(rest), "sites")
    found = keep_known_consequence(written(site_features(sites, t, known=True), "site_features"))
    rows, own = unnested(found, "_rows"), None
    if closure is not None:
        below = closure.groupBy(F.col("ancestor").alias("ttype")).agg(F.collect_set("node").alias("_below"))
        rows, own = rows.join(below, "ttype", "left"), F.coalesce("_below", F.array().cast("array<string>"))
    return rectify(one_hot_consequence(with_levels(rows, own).drop("_below"), "csqn_type"))


def select_features(df: DataFrame, keep: tuple[str, ...] = (), response: str = "response") -> DataFrame:
    """Model columns in their fixed order, the label, and the columns to keep."""
    return df.select(*keep, *[f for f in FEATURES if f in df.columns], F.col(response).alias("label"))


def train_models(splits: DataFrame, keys: list[str], features: list[str], row_id: str, least: int = 30, **options) -> tuple[DataFrame, DataFrame]:
    """Node rows of the members of all keys whose mean training size reaches ``least``; and the keys without a model.

    ``splits`` has the keys, split, role, label, row id and features.
    """
    enough = mean_train_size(splits, keys, least).select(*keys)
    nodes = train_ensemble(splits.join(enough, keys, "left_semi"), [*keys, "split"], features, row_id, **options)
    return nodes, failed_groups(splits, nodes, keys)


def cv_table(test: DataFrame, nodes: DataFrame, keys: list[str], features: list[str], row_id: str, label: str = "label") -> DataFrame:
    """(keys, row id, label, p): test rows with their own member's probability; keys include the split."""
    return test.select(*keys, row_id, label).join(score_members(test, nodes, keys, features, row_id), [*keys, row_id])


def predict_saturation(rows: DataFrame, nodes: DataFrame, selection: DataFrame, features: list[str], row_id: str, root: str | None = None) -> DataFrame:
    """(ttype, gene, row id, selected_ttype, score, class, attr_<feature> ...): consensus and mean attribution of the members of
    each gene's chosen model.

    A gene without a chosen model takes that of ``root``; without a root it is an error when its rows are computed.
    """
    asked = rows.join(selection, ["ttype", "gene"], "left")
    if root is None:
        fail = F.raise_error(F.concat(F.lit("no high-quality model: "), F.concat_ws(" ", "ttype", "gene"))).cast("string")
        asked = asked.withColumn("selected_ttype", F.when(F.col("selected_ttype").isNull(), fail).otherwise(F.col("selected_ttype")))
    else:
        asked = asked.withColumn("selected_ttype", F.coalesce("selected_ttype", F.lit(root)))
    asked = written(asked, "asked")
    models = nodes.withColumnRenamed("ttype", "selected_ttype")
    model = ["selected_ttype", "gene"]
    scored = consensus(score_members(asked, models, model, features, row_id, member="split"), [*model, row_id])
    explained = mean_attribution(tree_attribution(asked, models, model, features, row_id, member="split"), [*model, row_id])
    out = asked.select("ttype", "gene", row_id, "selected_ttype").join(scored, [*model, row_id]).join(explained, [*model, row_id])
    return out.withColumn("class", class_threshold(F.col("score")))
