"""Operators on literal rows: thresholds, open and closed ends, NULLs, ties, invariants of models."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drivescore.functions import variants as V
from drivescore.functions.uniform import pair_words, uniforms
from drivescore.operators import clusters, discovery, intervals, lookups, metrics, model, sequence, splits, tree
from drivescore.plans import training
from drivescore.sources import tables as src


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("I/T", "33", "3/3", "missense_variant,stop_gained", "0.1,.,0.3"), ("L", "33", "1/4", "odd", "-"), ("-", "1", "x", "intron_variant", ".,."), (None, None, None, None, None)], "aa string, pos string, exon string, csqn string, m string")
    out = df.select(V.format_aachange(F.col("aa"), F.col("pos")), V.nmd_flag(F.col("exon")), V.nmd_flag(F.col("exon"), True), V.classify_consequence(F.col("csqn")), F.round(V.mean_multivalue(F.col("m")), 6)).collect()
    assert [tuple(r) for r in out] == [("I33T", 1, 1, "nonsense", 0.2), ("L33L", 0, 1, None, None), (None, 0, 0, "splicing", None), (None, 0, 0, None, None)]
    assert len(set(V.context_keys())) == 96
    r = spark.sql("select 'TGC' t, 'A' a, 'ACA' u, 'G' b, 'NAC' n").select(V.pyrimidine_context(F.col("t"), F.col("a")), V.pyrimidine_context(F.col("u"), F.col("b")), V.pyrimidine_context(F.col("n"), F.col("a"))).first()
    assert tuple(r) == ("GCA>T", "ACA>G", None)
    r = spark.sql("select 'A33C' a, 'A3fs' b, cast(null as string) c").select(*[V.parse_aa_position(F.col(x)) for x in "abc"]).first()
    assert tuple(r) == (33, -1, -1)
    r = spark.sql("select 'chr1' a, 'X' b, '7.0' c, 'chrY' d").select(*[V.normalize_chrom(F.col(x)) for x in "abcd"]).first()
    assert tuple(r) == ("1", "X", "7", "Y")


def test_half_precision(spark):
    x = [0.0, 1.0, 0.1, -9.53125, 65504.0, 70000.0, 1e-7, 3.14159, 2049.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(V.half_precision(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(v)) for v in x]


def test_hash_uniform(spark):
    assert spark.range(1).select(V.hash_uniform(F.lit("a"), F.lit(1), F.lit(7))).first()[0] == pytest.approx(0.6611149166710675)


def test_intervals_are_closed_and_domains_open(spark):
    muts = spark.createDataFrame([("1", p, "A", "g") for p in (9, 10, 15, 20, 21)] + [("2", 15, "B", "h")], "chr string, pos int, ttype string, gene string")
    c = spark.createDataFrame([("1", 10, 20, "A"), ("1", 15, 30, "B"), ("1", 30, 10, "A")], "chr string, lo int, hi int, ttype string")
    for width in (4, 4096):
        got = {(r.chr, r.pos): r.level for r in intervals.interval_membership(muts, c, width=width).collect()}
        assert got == {("1", 9): 0, ("1", 10): 2, ("1", 15): 2, ("1", 20): 2, ("1", 21): 1, ("2", 15): 0}
    d = spark.createDataFrame([("g", 9, 20, "first", "A", 1), ("g", 9, 16, "second", "A", 2), ("g", 19, 22, "other", "B", 3)], "gene string, start_pos int, stop_pos int, element string, ttype string, ord int")
    got = {r.pos: (r.level, r.motif) for r in intervals.domain_membership(muts.filter("gene = 'g'"), d, width=5).collect()}
    assert got == {9: (0, ""), 10: (2, "second;first;"), 15: (2, "second;first;"), 20: (1, "other;"), 21: (1, "other;")}


def test_overlap_outer_keeps_all(spark):
    rows = spark.createDataFrame([("1", 4, 5), ("1", 4, 5), ("1", 100, 101), ("1", 3, 40)], "chr string, start int, end int")
    regions = spark.createDataFrame([("1", 0, 5, "a"), ("1", 5, 9, "b"), ("1", 4, 10_000, "c")], "chr string, r_start int, r_end int, r_gene string")
    for width in (3, 4096):
        got = values(intervals.region_overlap_outer(rows, regions, width=width).select("start", "end", "r_gene"))
        assert got == [(100, 101, "c"), (3, 40, "a"), (3, 40, "b"), (3, 40, "c"), (4, 5, "a"), (4, 5, "a"), (4, 5, "c"), (4, 5, "c")]


def test_ranges_of_all_lengths(spark):
    """Points and ranges from one base to a chromosome against brute force; a long range makes few rows."""
    rng = random.Random(2)
    spans = [(c, lo, lo + int(2 ** rng.uniform(0, 27)) - 1) for c in "12" for lo in (rng.randint(-50, 1 << 26) for _ in range(60))]
    spans += [("1", 0, 250_000_000), ("1", 255, 256), ("1", 256, 511), ("1", 256, 512), ("2", -3, -1), ("2", 5, 4)]
    points = sorted({("12"[k % 2], p) for k, p in enumerate([rng.randint(-60, 1 << 27) for _ in range(300)] + [s[k] + d for s in spans for k in (1, 2) for d in (-1, 0, 1)])})
    held = spark.createDataFrame([(c, lo, hi, "A") for c, lo, hi in spans], "chr string, lo int, hi int, ttype string")
    assert intervals.in_bins(held, "lo", "hi").count() <= 2 * len(spans)
    asked = spark.createDataFrame([(c, p, "A") for c, p in points], "chr string, pos int, ttype string")
    inside = {(r.chr, r.pos): r.level for r in intervals.interval_membership(asked, held).collect()}
    assert inside == {(c, p): 2 if any(c == d and lo <= p <= hi for d, lo, hi in spans) else 0 for c, p in points}
    regions = held.select("chr", F.col("lo").alias("r_start"), (F.col("hi") + 1).alias("r_end"))
    rows = [(c, p, p + 1) for c, p in points[::9]] + [(c, lo - 7, hi - 100) for c, lo, hi in spans[::5]] + [("3", 1, 2), ("1", 9, 9)]
    got = values(intervals.region_overlap_outer(spark.createDataFrame(rows, "chr string, start int, end int"), regions))
    want = []
    for c, s, e in rows:
        hit = [(c, s, e, lo, hi + 1) for d, lo, hi in spans if c == d and lo <= hi and s < hi + 1 and lo < e and s < e]
        want += hit or [(c, s, e, None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_signal_range(spark):
    df = spark.createDataFrame([("1", 10), ("1", 11), ("1", 20), ("1", 21)], "chr string, pos int")
    s = spark.createDataFrame([("chr1", 10, 20, 0.5)], "chrom string, start int, end int, value double")
    assert values(intervals.signal_at_point(df, s)) == [("1", 10, None), ("1", 11, 0.5), ("1", 20, 0.5), ("1", 21, None)]


def test_filters(spark):
    df = spark.createDataFrame([("a", "Missense", 1), ("a", "Nonsense", 2), ("b", "Missense", 3), ("a", "Other", 4), ("a", "Missense", None)], "gene string, impact string, k int")
    e = spark.createDataFrame([("a", 10.0, 1.0, 1.0), ("b", 10.0, None, 1.0)], "gene string, wmis double, wnon double, wspl double")
    assert values(clusters.filter_by_excess(df, e)) == [("a", "Missense", 1)]
    assert clusters.filter_significant(spark.createDataFrame([(0.05,), (0.051,)], "p double"), "p").count() == 1
    q = spark.createDataFrame([(0.1, 2.0, 1.0), (0.09, 2.0, 1.0), (0.05, 1.0, 1.0), (0.05, 1.0, 0.0)], "q double, o double, s double")
    assert clusters.filter_enriched_regions(q, "q", "o", "s").count() == 1


def test_unknown_cohort_fails(spark):
    c = spark.createDataFrame([("x", "A"), ("x", "B")], "cohort string, ttype string")
    assert values(lookups.cohort_to_ttype(spark.createDataFrame([("x",)], "cohort string"), c)) == [("x", "B")]
    with pytest.raises(Exception, match="unknown cohort"):
        lookups.cohort_to_ttype(spark.createDataFrame([("y",)], "cohort string"), c).collect()


def test_last_row_of_a_cohort_and_empty_inputs(spark):
    c = spark.createDataFrame([("x", "B", 1), ("x", "A", 2)], "cohort string, ttype string, line int")
    assert values(lookups.cohort_to_ttype(spark.createDataFrame([("x",)], "cohort string"), c, order="line")) == [("x", "A")]
    muts = spark.createDataFrame([("g", "no-SNV"), ("h", "Missense")], "gene string, impact string")
    with pytest.raises(ValueError, match="driver genes"):
        clusters.filter_driver_snvs(muts, spark.createDataFrame([("g",)], "gene string"))
    with pytest.raises(ValueError, match="known consequence"):
        training.keep_known_consequence(spark.createDataFrame([("odd",)], "csqn_type string"))
    names = "Chromosome string, Position int, Reference string, Alternate string, Gene string, Feature string, Consequence string, Symbol string, Mane_select string"
    with pytest.raises(ValueError, match="selected transcript"):
        src.read_saturation(spark.createDataFrame([("chr1", 1, "A", "C", "E", "T", "c", "g", "-")], names))


def test_protein_change(spark):
    df = spark.createDataFrame([("33", "A/C"), ("33", "L"), ("-", "A/C"), (None, "A")], "pos string, aa string")
    assert [r[0] for r in df.select(V.protein_change(F.col("pos"), F.col("aa"))).collect()] == ["A33C", "L33L", ".", None]


def test_annotation_belongs_to_its_gene(spark):
    """Two genes overlap: each site has the consequence of its own gene, and own tumor types may be those of a subtree."""
    sites = spark.createDataFrame([("T", "a", "1", 5, "C"), ("T", "b", "1", 5, "C")], "ttype string, gene string, chr string, pos int, alt string")
    ann = spark.createDataFrame([("a", "1", 5, "C", "NM", "missense_variant", "1/3", "A5C", 2), ("b", "1", 5, "C", "NM", "stop_gained", "3/3", "Q5*", 1), ("b", "1", 5, "C", "-", "intron_variant", "1/3", "-", 0)], "gene string, chr string, pos int, alt string, mane string, csqn string, exon string, aachange string, ord int")
    t = {
        "annotations": ann, "signal": spark.createDataFrame([("chr1", 4, 5, 0.1)], "chrom string, start int, end int, value double"),
        "flags": spark.createDataFrame([("a", "A5", [1, 0, 0, 0, 0, 1, 0, 0])], "gene string, residue string, flags array<int>"),
        "clusters": spark.createDataFrame([("1", 1, 9, "U")], "chr string, lo int, hi int, ttype string"), "points": spark.createDataFrame([("1", 5, "T")], "chr string, pos int, ttype string"),
        "domains": spark.createDataFrame([("a", 1, 9, "kin", "U", 1)], "gene string, start_pos int, stop_pos int, element string, ttype string, ord int"),
    }
    got = {r.gene: r for r in training.add_features(sites, t).collect()}
    assert [(got[g].csqn_type, got[g].nmd, got[g].CLUSTL, got[g].HotMaps, got[g].smRegions, got[g].motif, got[g].Acetylation, got[g].Methylation) for g in "ab"] == [("missense", 0, 1, 2, 1, "kin;", 1, 1), ("nonsense", 1, 1, 2, 0, "", 0, 0)]
    assert got["a"].PhyloP == float(np.float16(0.1))
    closure = tree.tree_closure(spark.createDataFrame([("T", None), ("U", "T")], "id string, parent string"))
    wide = {r.gene: r for r in training.annotate_saturation(sites.withColumn("ref", F.lit("A")), t, closure).collect()}
    assert wide["a"].CLUSTL == 2 and wide["a"].smRegions == 2 and wide["a"].motif == "kin;"


def test_saturation_meets_tables_once_a_site(spark, monkeypatch):
    """Rows of a site under many ttypes are one on the way: what is written has a row for each site. Repeats and all levels stay."""
    names = [f"t{k:02}" for k in range(30)]
    closure = tree.tree_closure(spark.createDataFrame([("r", None), *[(n, "r") for n in names]], "id string, parent string"))
    rows = [(n, "a", "1", p, "A", "C") for n in [*names, "r", "t00", "far"] for p in (5, 6)]
    saturation = spark.createDataFrame([*rows, ("t01", "a", "1", 9, "A", "C")], "ttype string, gene string, chr string, pos int, ref string, alt string")
    ann = spark.createDataFrame([("a", "1", p, "C", "NM", "missense_variant", "1/3", f"A{p}C", 1) for p in (5, 6)] + [("a", "1", 9, "C", "NM", "odd", "1/3", "A9C", 1)], "gene string, chr string, pos int, alt string, mane string, csqn string, exon string, aachange string, ord int")
    t = {
        "annotations": ann, "signal": spark.createDataFrame([("chr1", 4, 5, 0.1)], "chrom string, start int, end int, value double"),
        "flags": spark.createDataFrame([("a", "A5", [1, 0, 0, 0, 0, 1, 0, 0])], "gene string, residue string, flags array<int>"),
        "clusters": spark.createDataFrame([("1", 1, 5, "t03"), ("1", 6, 6, "odd"), ("1", 6, 6, None)], "chr string, lo int, hi int, ttype string"), "points": spark.createDataFrame([("1", 6, "t04")], "chr string, pos int, ttype string"),
        "domains": spark.createDataFrame([("a", 1, 9, "kin", "t05", 1), ("a", 1, 9, "kin", "t06", 1), ("a", 1, 7, "sh", "t06", 2), ("a", 1, 9, "no", None, 3)], "gene string, start_pos int, stop_pos int, element string, ttype string, ord int"),
    }
    kept, write = {}, training.written
    monkeypatch.setattr(training, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    got = values(training.annotate_saturation(saturation, t, closure).select("ttype", "pos", "CLUSTL", "HotMaps", "smRegions", "motif"))
    own = lambda n, *of: 2 if n in of else 1
    assert got == sorted([(n, p, own(n, "t03", "r") if p == 5 else 0, own(n, "t04", "r") if p == 6 else 0, own(n, "t05", "t06", "r"), "kin;" if n == "t05" else "sh;kin;") for n, *_, p, _, _ in rows], key=str)
    assert {n: df.count() for n, df in kept.items()} == {"sites": 3, "site_features": 2}


def test_sites_by_level_counts_a_site_once_a_node(spark):
    muts = [("1", 5, "A", "x"), ("1", 5, "A", "y"), ("1", 5, "A", "x"), ("1", 5, "C", "y"), ("2", 5, "A", "x"), ("1", 20, "A", "z"), ("1", 20, "A", None), ("1", 20, "A", "far")]
    ranges = [("1", 1, 5, "x"), ("2", 5, 5, "y"), ("1", 6, 19, "z")]
    tables = spark.createDataFrame(muts, "chr string, pos int, alt string, ttype string"), spark.createDataFrame(ranges, "chr string, lo int, hi int, ttype string")
    above = {"x": "xpr", "y": "ypr", "z": "zr"}
    closure = tree.tree_closure(spark.createDataFrame([("r", None), ("p", "r"), ("x", "p"), ("y", "p"), ("z", "r")], "id string, parent string"))
    want = set()
    for c, pos, alt, ttype in muts:
        types = {k for a, lo, hi, k in ranges if a == c and lo <= pos <= hi}
        want |= {(node, 2 if ttype in types else int(bool(types)), c, pos, alt) for node in above.get(ttype, "")}
    count = {k: sum(w[:2] == k for w in want) for k in {w[:2] for w in want}}
    assert values(intervals.sites_by_level(*tables, closure, ["pos", "chr", "alt"]).select("node", "level", "n_unique")) == sorted([(*k, n) for k, n in count.items()], key=str)


def test_units_are_dealt_before_they_become_replicates(spark, monkeypatch):
    seen, number = [], discovery.numbered
    monkeypatch.setattr(discovery, "numbered", lambda rows, *rest: seen.append(rows) or number(rows, *rest))
    df = spark.createDataFrame([("t", f"s{k}", k % 3) for k in range(40)], "t string, s string, pos int").coalesce(1)
    assert discovery.downsample_curve(df, df.select("t", "s"), ["t"], "s", ["pos"], replicates=5, grid=7).count() == 35
    assert seen[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_are_dealt_before_they_become_splits(spark, monkeypatch):
    seen, smallest = [], splits.among_smallest
    monkeypatch.setattr(splits, "among_smallest", lambda rows, *rest: seen.append(rows) or smallest(rows, *rest))
    df = spark.createDataFrame([("g", k, int(k < 10)) for k in range(40)], "g string, id int, label int").coalesce(1)
    assert splits.balanced_splits(df, ["g"], "id", n_splits=3).count() == 60
    assert seen[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_hashes_of_splits_and_their_cut_offs_are_written_once(spark, monkeypatch):
    seen, plain = [], splits.written
    monkeypatch.setattr(splits, "written", lambda df, name: seen.append((name, set(df.columns))) or plain(df, name))
    df = spark.createDataFrame([("g", k, int(k < 10)) for k in range(40)], "g string, id int, label int")
    assert splits.balanced_splits(df, ["g"], "id", n_splits=3).count() == 60
    assert [n for n, _ in seen] == ["labelled", "hashed", "cuts", "chosen", "cuts"] and "_u" in seen[1][1]


def test_rows_that_cannot_stay_get_no_row_for_a_split(spark, monkeypatch):
    kept, plain = {}, splits.written
    monkeypatch.setattr(splits, "written", lambda df, name: kept.setdefault(name, plain(df, name)) if name == "hashed" else plain(df, name))
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, null, 'g') as k", "id", "cast(id < 200 as int) as label", "id * 2 as x")
    got = splits.balanced_splits(df, ["k"], "id", n_splits=3, more=["x"]).cache()
    assert kept["hashed"].count() < 4_000  # 60,000 rows and splits before
    assert {(r.k, r.label): r["count"] for r in got.groupBy("k", "label").count().collect()} == {(None, 0): 201, (None, 1): 201, ("g", 0): 399, ("g", 1): 399}
    assert got.filter("x <> id * 2 or x is null").isEmpty()
    u = splits.hash_uniform(F.col("id"), F.col("split"), F.lit(1))
    drawn = df.filter("label = 0").withColumn("split", F.explode(F.array(*map(F.lit, range(3))))).withColumn("n", F.row_number().over(splits.W.partitionBy("k", "split").orderBy(u, "id")))
    want = drawn.filter("n <= if(k is null, 67, 133)").select("k", "id", "split")
    assert values(want) == values(got.filter("label = 0").select("k", "id", "split"))
    role = splits.W.partitionBy("k", "split").orderBy(splits.hash_uniform(F.col("id"), F.col("split"), F.lit(1), F.lit("role")), "id")
    assert got.withColumn("n", F.row_number().over(role)).filter("(role = 'test') <> (n <= if(k is null, 41, 80))").isEmpty()


def test_hashes_of_pairs_equal_those_of_rows(spark):
    texts = ["7", None, "", "0123456789" * 12, "\u00e9\u4e2d", "41", "x" * 55, "y" * 47, "42"]
    rows, numbers = (a.ravel() for a in np.meshgrid(np.arange(7), [0, 9, 10, 123], indexing="ij"))
    df = spark.createDataFrame([(k, texts[2:][r], int(n)) for k, (r, n) in enumerate(zip(rows, numbers, strict=True))], "k int, t string, n int")
    want = [r.u * 2**32 for r in df.withColumn("u", splits.hash_uniform(F.col("t"), F.col("n"), F.lit(5), F.lit("role"))).orderBy("k").collect()]
    assert pair_words(pa.array(texts).slice(2), rows, numbers, b"5|role").tolist() == want
    none = spark.range(1).select(splits.hash_uniform(F.lit(None).cast("string"), F.lit(12), F.lit(1))).first()[0]
    assert pair_words(pa.array([None, "a"]), np.array([0]), np.array([12]), b"1").tolist() == [none * 2**32]


def test_scores_keep_the_types_of_keys_and_ids(spark):
    rows = spark.createDataFrame([(1, f"r{k}", float(k)) for k in range(5)] + [(2, "alone", 1.0), (None, "none", None)], "g long, id string, x double")
    stump = [(0, 0, 0, 2.0, 1, 2, 0.0, 5.0), (0, 1, -1, 0.0, -1, -1, -1.0, 2.0), (0, 2, -1, 0.0, -1, -1, 1.0, 3.0)]
    nodes = spark.createDataFrame([(g, m, *r, 0.0) for g in (1, 3) for m in ("b", None, "a") for r in stump], f"g long, m string, {model.NODE_COLUMNS}")
    got = model.score_members(rows, nodes, ["g"], ["x"], "id", member="m")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("g", "bigint"), ("m", "string"), ("id", "string"), ("p", "double")]
    assert [r[:3] for r in values(got)] == sorted([(1, m, f"r{k}") for k in range(5) for m in "ab"], key=str)
    assert all(r.p == pytest.approx(1 / (1 + np.exp(1 if r.id < "r2" else -1))) for r in got.collect())


def test_background_follows_context_rates(spark):
    t = {"sequences": spark.createDataFrame([("g", "1", 100, "ACGTNACA"), ("h", "1", 300, "TTTT"), ("other", "1", 900, "ACGT")], "gene string, chr string, start int, seq string"), "rates": spark.createDataFrame([("ACG>T", 3.0), ("ACA>G", 1.0)], "context string, rate double")}
    counts = spark.createDataFrame([("T", "g", 40), ("T", "h", 5)], "ttype string, gene string, n int")
    rows = training.background(t, counts).collect()
    at = [(r.gene, r.pos, r.ref, r.alt) for r in rows]
    # ACG at 100, its complement CGT at 101, ACA at 105; TTT of h has no rate, so its six changes are drawn evenly.
    assert len(at) == 50 * 45 and {x[1:] for x in at if x[0] == "g"} == {(100, "C", "T"), (101, "G", "A"), (105, "C", "G")}
    assert abs(sum(x[1] == 105 for x in at) / 2000 - 1 / 7) < 0.03
    assert {x[1:] for x in at if x[0] == "h"} == {(p, "T", a) for p in (300, 301) for a in "ACG"}


def test_median_iqr(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in "ab" for v in rng.integers(-4, 5, 37)] + [("c", 2.5), ("d", None), (None, 1.0), (None, 4.0), ("a", None)]
    got = {r.g: (r.low, r.median, r.high) for r in metrics.median_iqr(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got["d"] == (None, None, None)
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(tuple(np.percentile([v for k, v in rows if k == g and v is not None], [25, 50, 75])))


def plain_value(nodes, x):
    at = 0
    while nodes[at][0] >= 0:
        v = x[int(nodes[at][0])]
        at = int(nodes[at][2] if v is None or v < nodes[at][1] else nodes[at][3])
    return nodes[at][4]


def test_models_against_plain_trees(spark):
    """Training, scores, consensus and attributions of a small ensemble, each row by walking its trees."""
    rng = np.random.default_rng(6)
    rows = []
    for gene in ("g", "h"):
        for k in range(60):
            x, y = float(rng.normal()), float(rng.normal())
            rows.append(("T", gene, k + 100 * (gene == "h"), int(x + rng.normal(scale=0.4) > 0), x, None if k % 9 == 0 else y))
    df = spark.createDataFrame(rows, "ttype string, gene string, id int, label int, x double, y double")
    cut = splits.balanced_splits(df, ["ttype", "gene"], "id", n_splits=3).join(df.drop("label"), ["ttype", "gene", "id"])
    few = cut.filter("gene = 'g' or id < 104")  # too few rows of h
    nodes, failed = training.train_models(few, ["ttype", "gene"], ["x", "y"], "id", least=20, rounds=6, rate=0.3, patience=3)
    nodes = spark.createDataFrame(nodes.collect(), nodes.schema)
    assert {(r.gene, r.split) for r in nodes.collect()} == {("g", s) for s in range(3)} and [r.gene for r in failed.collect()] == ["h"]
    models = {}
    for r in nodes.collect():
        models.setdefault((r.split, r.tree), {})[r.node] = (r.feature, r.threshold, r.left_node, r.right_node, r.value)
    base = {r.split: r.base_margin for r in nodes.collect()}
    features = {r[2]: (r[4], r[5]) for r in rows if r[1] == "g"}
    margin = {(s, i): base[s] + sum(plain_value(t, x) for (k, _), t in models.items() if k == s) for s in range(3) for i, x in features.items()}
    scored = {(r.split, r.id): r.p for r in model.score_members(df.filter("gene = 'g'"), nodes, ["ttype", "gene"], ["x", "y"], "id", member="split").collect()}
    assert scored == pytest.approx({k: 1 / (1 + np.exp(-m)) for k, m in margin.items()})
    test = cut.filter("gene = 'g' and role = 'test'")
    table = training.cv_table(test, nodes, ["ttype", "gene", "split"], ["x", "y"], "id").collect()
    assert len(table) == test.count() and all(r.p == pytest.approx(scored[r.split, r.id]) for r in table)
    selection = spark.createDataFrame([("T", "g", "T")], "ttype string, gene string, selected_ttype string")
    out = training.predict_saturation(df.filter("gene = 'g'"), nodes, selection, ["x", "y"], "id").collect()
    means = {i: np.mean([margin[s, i] for s in range(3)]) for i in features}
    assert {r.id: r.score for r in out} == pytest.approx({i: 1 / (1 + np.exp(-2.3 * m)) for i, m in means.items()})
    assert all(r["class"] == (r.score >= 0.5) for r in out)
    expected = {r.id: r.base for r in model.tree_attribution(df.filter("gene = 'g'"), nodes, ["ttype", "gene"], ["x", "y"], "id", member="split").groupBy("id").agg(F.avg("base").alias("base")).collect()}
    assert {r.id: expected[r.id] + r.attr_x + r.attr_y for r in out} == pytest.approx(means)
    curve = model.learning_curves(few.filter("gene = 'g'"), ["ttype", "gene", "split"], ["x", "y"], "id", rounds=6, rate=0.3, patience=3).collect()
    assert {(r.split, r["round"]) for r in curve} == set(models)
    q = {(r.split, r.id): r.label for r in test.collect()}
    for s in range(3):
        last = [-(np.log(scored[k]) if y else np.log(1 - scored[k])) for k, y in q.items() if k[0] == s]
        assert np.mean(last) == pytest.approx(min(r.logloss for r in curve if r.split == s))
    with pytest.raises(Exception, match="no high-quality model: T h"):
        training.predict_saturation(df, nodes, selection, ["x", "y"], "id").collect()


def test_tree(spark):
    edges = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a")], "id string, parent string")
    closure = tree.tree_closure(edges)
    assert closure.filter("ancestor = 'r'").count() == 4 and closure.filter("depth = 0").count() == 4
    assert values(tree.leaves_of(closure).filter("node = 'r'")) == [("r", "b"), ("r", "c")]
    ev = spark.createDataFrame([("c", "g", False), ("a", "g", True), ("r", "g", True), ("b", "h", False)], "ttype string, gene string, qualifies boolean")
    near = {(r.ttype, r.gene): r.selected_ttype for r in tree.qualifying_ancestor(closure, ev, "gene").collect()}
    far = {(r.ttype, r.gene): r.selected_ttype for r in tree.qualifying_ancestor(closure, ev, "gene", farthest=True).collect()}
    assert near == {("c", "g"): "a", ("a", "g"): "a", ("r", "g"): "r"}
    assert far == {("c", "g"): "r", ("a", "g"): "r", ("r", "g"): "r", ("b", "h"): None}
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "id string, parent string")
    below = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("t", "x"), ("u", "t"), ("r", None)], "id string, parent string")
    for edges_of in (loop, below):
        with pytest.raises(ValueError, match="cycle"):
            tree.tree_closure(edges_of)
    chain = tree.tree_closure(spark.createDataFrame([(k, k + 1 if k < 999 else None) for k in range(1000)], "id int, parent int"))
    assert chain.count() == 1000 * 1001 // 2 and chain.filter("ancestor - node <> depth").count() == 0
    assert tree.tree_closure(edges.limit(0)).count() == 0
    cohorts = spark.createDataFrame([("x", "c"), ("y", "b")], "cohort string, ttype string")
    assert values(tree.subtree_cohorts(closure, cohorts, node="a")) == [("a", "x")]
    with pytest.raises(ValueError, match="unknown tumor type: z"):
        tree.subtree_cohorts(closure, cohorts, node="z")
    rows = spark.createDataFrame([("c", 1), ("b", 2)], "ttype string, k int")
    assert values(tree.subtree_filter(rows, closure, "a")) == [("c", 1)]
    assert values(tree.at_ancestors(rows, closure).select("ttype", "k")) == [("a", 1), ("b", 2), ("c", 1), ("r", 1), ("r", 2)]


def test_one_class_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.9), ("b", 1, 0.2)], "g string, label int, p double")
    auc = {r.g: r.auc for r in metrics.roc_auc(df, ["g"]).collect()}
    assert auc == {"a": 0.5, "b": None}
    assert {r.g: r.logloss for r in metrics.log_loss(df, ["g"]).collect()}["b"] is None
    assert metrics.consensus(spark.createDataFrame([("a", 1.0), ("a", 1.0)], "g string, p double"), ["g"]).first().score == pytest.approx(1.0)
    empty = df.limit(0)
    assert metrics.pr_auc(empty, ["g"]).count() == 0 and metrics.binary_metrics(empty, ["g"]).count() == 0


def test_draws_follow_weights_and_invalid_weights_are_uniform(spark):
    rows = [("a", k, float(w)) for k, w in enumerate([1, 0, 3])] + [("z", k, 0.0) for k in range(4)]
    c = spark.createDataFrame(rows, "gene string, k int, w double")
    n = spark.createDataFrame([("a", 200), ("z", 200)], "gene string, n int")
    got = sequence.weighted_draw(c, n, "w", ["gene"], ["k"], per_row=10).groupBy("gene", "k").count().collect()
    count = {(r.gene, r.k): r["count"] for r in got}
    assert sum(count.values()) == 4000 and ("a", 1) not in count
    assert abs(count["a", 2] / 2000 - 0.75) < 0.04 and all(abs(count["z", k] / 2000 - 0.25) < 0.04 for k in range(4))


@pytest.mark.parametrize("slice_rows", [None, 3])
def test_counted_draws_equal_single_draws(spark, monkeypatch, slice_rows):
    rows = [("a", k, float(w)) for k, w in enumerate([1, 0, 3, 0.5, 0.25, 7, 0.1])] + [("z", k, 0.0) for k in range(4)] + [(None, 1, 1.0)]
    c = spark.createDataFrame(rows, "gene string, k int, w double")
    n = spark.createDataFrame([("t", "a", 30), (None, "a", 21), ("t", "z", 7), ("u", None, 5), ("u", "a", 0)], "ttype string, gene string, n int")
    want = {(r.ttype, r.gene, r.k): r["count"] for r in sequence.weighted_draw(c, n, "w", ["gene"], ["k"], 1, 50, ("ttype",)).groupBy("ttype", "gene", "k").count().collect()}
    monkeypatch.setattr(sequence, "RUN_DRAWS", 400)
    if slice_rows:
        monkeypatch.setattr(sequence, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(sequence, "SLICE_ROWS", slice_rows)
    got = sequence.drawn_counts(c, n, "w", ["gene"], ["k"], 1, 50, ("ttype",)).select("gene", "k", F.explode("drawn").alias("d"))
    got = got.groupBy("d.ttype", "gene", "k").agg(F.sum("d.n").alias("n")).collect()
    assert {(r.ttype, r.gene, r.k): r.n for r in got} == want and sum(want.values()) == 50 * 58


@pytest.mark.parametrize("slice_rows", [None, 3])
def test_counted_draws_by_place_equal_single_draws(spark, monkeypatch, slice_rows):
    rows = [("a", k, float(w)) for k, w in enumerate([1, 0, 3, 0.5, 0.25, 7, 0.1])] + [("z", k, 0.0) for k in range(4)]
    c = spark.createDataFrame(rows, "gene string, k int, w double")
    n = spark.createDataFrame([("t", "a", 30), (None, "a", 21), ("t", "z", 7), ("u", "a", 2)], "ttype string, gene string, n int")
    want = {(r.ttype, r.gene, r.k): r["count"] for r in sequence.weighted_draw(c, n, "w", ["gene"], ["k"], 1, 50, ("ttype",)).groupBy("ttype", "gene", "k").count().collect()}
    monkeypatch.setattr(sequence, "RUN_DRAWS", 400)
    if slice_rows:
        monkeypatch.setattr(sequence, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(sequence, "SLICE_ROWS", slice_rows)
    got = sequence.drawn_counts(c, n, "w", ["gene"], ["k"], 1, 50, ("ttype",), wide=["t", "u", None]).select("gene", "k", F.posexplode("drawn").alias("place", "n"))
    got = got.groupBy("place", "gene", "k").agg(F.sum("n").alias("n")).filter("n > 0").collect()
    assert {(["t", "u", None][r.place], r.gene, r.k): r.n for r in got} == want and sum(want.values()) == 50 * 60


@pytest.mark.parametrize("before", [b"", b"NATION_1|Brand#11|", b"x" * 50, b"y" * 64, b"z" * 120])
def test_draws_are_hashes_of_their_numbers(before):
    for first, last in ((1, 25), (95, 105), (9_990, 10_012), (99_990, 110_025)):
        want = [int(hashlib.md5(before + str(k).encode() + b"|1").hexdigest()[:8], 16) for k in range(first, last + 1)]
        assert np.concatenate(list(uniforms(before, first, last, b"|1"))).tolist() == want


def test_thresholds_of_draws_part_them_as_their_numbers_do():
    at = np.random.default_rng(1)
    for total in (1.0, 3.7, 1e-9, 1e12):
        u = np.sort(at.integers(0, 1 << 32, 500))
        ends = np.sort(np.concatenate([at.random(200) * total, u[::3] / 4294967296.0 * total, [total, total * 1.5]]))
        assert (np.searchsorted(u, sequence._first_beyond(ends, total)) == np.searchsorted(u / 4294967296.0 * total, ends)).all()


def test_bases_are_dealt_before_they_are_made(spark):
    regions = spark.createDataFrame([("g", k, "ACGTN") for k in range(50)], "gene string, start int, seq string").coalesce(1)
    bases = sequence.explode_bases(regions, ["gene"])
    plan = bases._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression") and bases.count() == 150


def test_occupied_bins_are_those_of_the_ranges(spark):
    ranges = [(0, 1), (10, 9), (95, 131), (100, 128), (130, 139), (500, 500), (None, 3)]
    a = spark.createDataFrame(ranges[:4], "lo int, hi int")
    b = spark.createDataFrame(ranges[4:], "lo int, hi int")
    got = [r[0] for r in intervals.occupied([(a, "lo", "hi"), (b, "lo", "hi")], "bin", 10).collect()]
    assert sorted(got) == [0, 9, 10, 11, 12, 13, 50]


def test_splits_are_balanced(spark):
    df = spark.createDataFrame([("g", k, int(k < 12)) for k in range(100)] + [("h", k, int(k > 102)) for k in range(100, 106)], "gene string, id int, label int")
    got = splits.balanced_splits(df, ["gene"], "id", n_splits=6).collect()
    for s in range(6):
        own = [r for r in got if r.split == s and r.gene == "g"]
        assert sum(r.label for r in own) == 12 and len(own) == 24
        assert sum(r.role == "test" for r in own) == 8
        assert len({r.id for r in own}) == len(own)
    assert got == splits.balanced_splits(df.repartition(7), ["gene"], "id", n_splits=6).collect() or sorted(map(tuple, got)) == sorted(map(tuple, splits.balanced_splits(df.repartition(7), ["gene"], "id", n_splits=6).collect()))


def test_downsampling_equals_explicit_subsets(spark):
    rows = [("A", f"s{k % 9}", (k * 7) % 5 + (k % 9)) for k in range(30)]
    df = spark.createDataFrame(rows, "t string, s string, pos int")
    samples = df.select("t", "s").distinct()
    got = {(r.replicate, r.point): (r.x, r.n_unique) for r in discovery.downsample_curve(df, samples, ["t"], "s", ["pos"], replicates=5, grid=7).collect()}
    import hashlib

    for rep in range(5):
        order = sorted({r[1] for r in rows}, key=lambda s: (int(hashlib.md5(f"{s}|1|{rep}|1".encode()).hexdigest()[:8], 16), s))
        for point in range(7):
            x = point * 9 / 6
            kept = set(order[: int(x)])
            assert got[rep, point] == (pytest.approx(x), len({r[2] for r in rows if r[1] in kept}))


def test_saturation_fits_are_the_least_squares(spark):
    """Squared errors are at most those of a fine grid, for saturated, linear, flat and noisy curves."""
    rng = np.random.default_rng(5)
    rows, x = [], [k * 40 / 19 for k in range(20)]
    shapes = {"sat": lambda v: 300 * (1 - np.exp(-0.1 * v)), "steep": lambda v: 50 * (1 - np.exp(-3 * v)), "line": lambda v: 4 * v, "flat": lambda v: 7 + 0 * v, "noise": lambda v: rng.integers(0, 30)}
    for name, f in shapes.items():
        for r in range(6):
            rows += [(name, r, k, v, 40, int(max(0, f(v) + rng.normal(scale=2 if name in ("sat", "line") else 0)))) for k, v in enumerate(x)]
    rows += [("none", 0, k, v, 40, 0) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, replicate int, point int, x double, n_samples int, n_unique int")
    got = {(r.g, r.replicate): r for r in discovery.fit_saturation_curve(df, ["g"]).collect()}
    assert set(got) == {(g, r) for g in shapes for r in range(6)}
    lam = np.exp(np.linspace(np.log(1e-7), np.log(10), 40_000))
    for g in shapes:
        own = np.array([[y for n, k, p, *_, y in rows if n == g and k == r] for r in range(6)], float)
        w = 1 / (1 + own.std(0) ** (2 * np.log10(20)))
        curve = 1 - np.exp(-lam[:, None] * np.array(x))
        for r in range(6):
            yg, gg = curve @ (w * own[r]), curve**2 @ w
            m = np.maximum(own.max() / 2, yg / gg)
            best = ((m[:, None] * curve - own[r]) ** 2 @ w).min()
            fit = got[g, r]
            mine = (w * (fit.m * (1 - np.exp(-fit.lam * np.array(x))) - own[r]) ** 2).sum()
            assert mine <= best + 1e-6 * max(1, best) and fit.sse == pytest.approx(mine, abs=1e-6) and 0.999e-7 <= fit.lam <= 10.000001


def test_booster_learns_and_attribution_adds_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[rng.random((300, 4)) < 0.05] = np.nan
    y = (np.nan_to_num(x[:, 0]) + (np.nan_to_num(x[:, 1]) > 0) + rng.normal(scale=0.3, size=300) > 0.5).astype(float)
    trees, base, curve = model.fit_booster(x[:200], y[:200], x[200:], y[200:], 60, 0.1, 10, 4)
    share = y[:200].mean()
    plain = -(y[200:] * np.log(share) + (1 - y[200:]) * np.log(1 - share)).mean()
    assert min(curve) < 0.7 * plain
    again, _, _ = model.fit_booster(x[:200], y[:200], x[200:], y[200:], 60, 0.1, 10, 4)
    assert all(np.array_equal(a, b) for a, b in zip(trees, again, strict=True))
    out, start, margin = np.zeros((20, 4)), base, np.full(20, base)
    for t in trees:
        start += model.tree_shapley(t, x[:20], out)
        margin += model.tree_values(t, x[:20])
    assert np.allclose(start + out.sum(1), margin)


def test_shapley_matches_permutations():
    from itertools import permutations

    nodes = np.array([[0, 0.0, 1, 2, 0, 10], [1, 0.5, 3, 4, 0, 6], [-1, 0, -1, -1, 2.0, 4], [-1, 0, -1, -1, -1.0, 5], [-1, 0, -1, -1, 3.0, 1]], float)
    x = np.array([[-1.0, 1.0, 0.0]])

    def value(known, at=0):
        f, threshold, left, right, v, cover = nodes[at]
        if f < 0:
            return v
        children = (int(left), int(right))
        if int(f) in known:
            return value(known, children[int(x[0, int(f)] >= threshold)])
        total = sum(nodes[c][5] for c in children)
        return sum(nodes[c][5] / total * value(known, c) for c in children)

    want = np.zeros(3)
    for order in permutations(range(3)):
        for k, f in enumerate(order):
            want[f] += (value(set(order[: k + 1])) - value(set(order[:k]))) / 6
    out = np.zeros((1, 3))
    assert model.tree_shapley(nodes, x, out) == pytest.approx(value(set()))
    assert np.allclose(out[0], want)


def test_sources(spark, tmp_path):
    (tmp_path / "COH1.tsv").write_text("chr\tpos\n1\t5\n")
    (tmp_path / "COH2.x.tsv").write_text("chr\tpos\nX\t6\n")
    assert values(src.scan_with_key(spark, f"{tmp_path}/*.tsv", "chr string, pos int")) == [("1", 5, "COH1"), ("X", 6, "COH2")]
    (tmp_path / "a.json").write_text('{"donors": {"d": ["s1", "s2"]},\n "hypermutators": {"hypermutators": ["s3"]}}')
    got = src.read_json_by_key(spark, f"{tmp_path}/*.json", "donors map<string,array<string>>, hypermutators struct<hypermutators:array<string>>")
    assert values(clusters.explode_samples(got.select("COHORT", "donors", "hypermutators.hypermutators"), "COHORT")) == [("a", "s1"), ("a", "s2"), ("a", "s3")]
    (tmp_path / "COH3.tsv.gz").write_bytes(b"no gzip")  # only its key's readers would fail
    for key in ("COH1", "COH2"):
        kept = src.scan_with_key(spark, f"{tmp_path}/*.tsv*", "chr string, pos int").filter(F.col("COHORT") == key)
        assert [r.COHORT for r in kept.collect()] == [key]
    with pytest.raises(Exception, match="(?i)gzip|FAILED_READ_FILE"):
        src.scan_with_key(spark, f"{tmp_path}/*.tsv*", "chr string, pos int").filter("COHORT = 'COH3'").collect()
    (tmp_path / "b.json").write_text("{ not json")
    asked = src.read_json_by_key(spark, f"{tmp_path}/*.json", "donors map<string,array<string>>").filter("COHORT = 'a'")
    assert len(asked.collect()) == 1 and "file_path" in asked._jdf.queryExecution().toString()
    (tmp_path / "t.txt").write_text("## c\nx\n# y\n")
    assert src.read_trace_skip_comments(spark, f"{tmp_path}/t.txt").count() == 2


def test_keyed_writes_give_one_file_a_key(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 40).cast("string").alias("cohort"), "id")
    src.write_tsv(rows, f"{tmp_path}/t", ["cohort"])
    src.write_json(rows, f"{tmp_path}/j", ["cohort"])
    src.write_parquet(rows, f"{tmp_path}/p", ["cohort"])
    for kind in "tjp":
        assert len(list((tmp_path / kind).glob("cohort=*/part-*"))) == 40
    got = src.scan_with_key(spark, f"{tmp_path}/t/*", "id long", "key", r"cohort=([^/]+)/").groupBy("key").count()
    assert sorted(values(got)) == sorted((str(k), 100) for k in range(40))


def test_rows_are_dealt_by_the_members_that_they_meet(spark, monkeypatch):
    rows = spark.createDataFrame([("a", k, float(k % 7)) for k in range(60)] + [("b", 500, 1.0)], "gene string, id int, x double")
    nodes = spark.createDataFrame([(g, m, 0, 0, -1, 0.0, -1, -1, float(m), 4.0, 0.5) for g in "ab" for m in range(10)], f"gene string, split int, {model.NODE_COLUMNS}")
    monkeypatch.setattr(model, "TASK_MEETS", 50)
    left, right = model.dealt(rows, nodes, ["gene"], "id", member="split")
    assert left.filter("gene = 'a'").agg(F.max("_salt")).first()[0] == 11 and right.filter("gene = 'b'").count() == 10
    assert left.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(values(model.score_members(rows, nodes, ["gene"], ["x"], "id", member="split"))) == 610
    mean = model.mean_attribution(model.tree_attribution(rows, nodes, ["gene"], ["x"], "id", member="split"), ["gene", "id"])
    assert sorted(values(mean)) == sorted([("a", k, 0.0) for k in range(60)] + [("b", 500, 0.0)])


def test_large_keys_are_dealt_over_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([("a", k, float(k % 7)) for k in range(100)] + [("b", 500, 1.0), (None, 600, 1.0)], "gene string, id int, x double")
    stump = [(0, 0, 0, 3.0, 1, 2, 0.0, 10.0), (0, 1, -1, 0.0, -1, -1, -1.0, 4.0), (0, 2, -1, 0.0, -1, -1, 1.0, 6.0)]
    names = [c.strip().split()[0] for c in model.NODE_COLUMNS.split(",")]
    places = dict(zip(("tree", "node", "feature", "threshold", "left_node", "right_node", "value", "cover"), range(8), strict=True))
    nodes = spark.createDataFrame([(g, *[0.5 if n == "base_margin" else r[places[n]] for n in names]) for g in "ab" for r in stump], f"gene string, {model.NODE_COLUMNS}")
    score = lambda: values(model.score_members(rows, nodes, ["gene"], ["x"], "id"))
    explain = lambda: values(model.tree_attribution(rows, nodes, ["gene"], ["x"], "id"))
    whole = score(), explain()
    assert len(whole[0]) == len(whole[1]) == 101
    monkeypatch.setattr(model, "TASK_ROWS", 16)
    assert (score(), explain()) == whole
    left, right = model.dealt(rows, nodes, ["gene"], "id")
    assert left.filter("gene = 'a'").select("_salt").distinct().count() == 7 and right.filter("gene = 'a'").count() == 21
    assert left.count() == 102 and right.filter("gene = 'b'").count() == 3
