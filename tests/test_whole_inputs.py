"""Queries over whole views against brute force on the smallest tables."""

import hashlib
import json
import math
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from drivescore.fixtures import Tables
from drivescore.operators import clusters, intervals, model
from drivescore.plans import training
from drivescore.queries import MODEL_FEATURES, QUERIES, QUICK

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def view(spark):
    t = Tables(spark, FOLDER)
    return lambda name, *columns: [tuple(r) for r in t[name].select(*columns).collect()]


def test_saturation_vectors_and_distances_take_every_position(spark, view):
    by = defaultdict(dict)
    for gene, ttype, pos, impact in view("fx_tmuts", "gene", "ttype", "pos", "impact"):
        own = by[gene, ttype]
        own[pos] = max(own.get(pos, 0), int(impact == "Missense"))
    vectors = {k: [own[p] for p in sorted(own)] for k, own in by.items()}
    got = {(r.gene, r.ttype): r.vector for r in QUERIES["saturation_vectors"](spark, FOLDER).collect()}
    assert got == {k: "".join(map(str, v)) for k, v in vectors.items()}

    want = {}
    for (gene, a), x in vectors.items():
        for (other, b), y in vectors.items():
            if gene == other and a < b:
                n = max(len(x), len(y))
                pairs = list(zip(x + [0] * (n - len(x)), y + [0] * (n - len(y)), strict=True))
                tp, fp, fn, tn = (pairs.count(c) for c in ((1, 1), (1, 0), (0, 1), (0, 0)))
                root = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
                want[gene, a, b] = max(1 - ((tp * tn - fp * fn) / root if root else 0), 0)
    rows = QUERIES["pairwise_mcc_distance"](spark, FOLDER).collect()
    assert len(rows) == len(want)
    assert {(r.gene, r.a, r.b): r.distance for r in rows} == pytest.approx(want, abs=1e-6)


def test_saturation_vectors_take_all_of_the_larger_tables(spark):
    folder = "/root/testdata/sf0.01"
    positions = Tables(spark, folder)["fx_tmuts"].select("gene", "ttype", "pos").distinct()
    got = QUERIES["saturation_vectors"](spark, folder).selectExpr("sum(length(vector)) as n").first().n
    assert got == positions.count() > 2 * positions.filter("pos < 400").count()


def test_parse_aa_position_takes_every_row(spark, view):
    got = {r.id: (r.strict, r.digits) for r in QUERIES["parse_aa_position"](spark, FOLDER).collect()}
    assert got == {i: ((-1, i), (-1, None), (i, i))[i % 3] for (i,) in view("fx_scored", "id")}


def test_signal_at_point_takes_every_interval(spark, view):
    ranges, sites = view("fx_clusters", "chr", "lo", "hi", "p_value"), set(view("fx_muts", "chr", "pos"))
    want = {(c, p): min((v for k, lo, hi, v in ranges if k == c and lo < p <= hi), default=None) for c, p in sites}
    rows = QUERIES["signal_at_point"](spark, FOLDER).collect()
    assert len(rows) == len(want) and {(r.chr, r.pos): r.signal for r in rows} == want


def above(view):
    """Each node's ancestors, itself included."""
    parent = dict(view("fx_tree", "id", "parent"))
    out = {}
    for node in parent:
        out[node], at = [], node
        while at is not None:
            out[node].append(at)
            at = parent.get(at)
    return out


def test_explode_samples_takes_every_donor(spark, view):
    ancestors, ttype = above(view), dict(view("fx_cohorts", "cohort", "ttype"))
    muts = view("fx_muts", "cohort", "gene", "sample_id", "pos")
    samples = [(c, s) for c, _, s in {m[:3] for m in muts}] + list({(c, s) for c, _, s, p in muts if p % 500 == 1})
    want = Counter((node, s) for c, s in samples for node in ancestors[ttype[c]])
    assert {(r.node, r["sample"]): r.n for r in QUERIES["explode_samples"](spark, FOLDER).collect()} == want


def test_samples_meet_by_name_before_they_multiply(spark, monkeypatch):
    seen, explode, attach = {}, clusters.explode_samples, clusters.attach_ttypes
    monkeypatch.setattr(clusters, "explode_samples", lambda df: seen.update(lists=df) or explode(df))
    monkeypatch.setattr(clusters, "attach_ttypes", lambda samples, nodes: seen.update(samples=samples) or attach(samples, nodes))
    plan = QUERIES["explode_samples"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert max(len(r.donors or {}) for r in seen["lists"].collect()) == 1
    assert "hashpartitioning(sample" in plan and "hashpartitioning(node" not in plan
    rows = spark.createDataFrame([("a", {"g": ["s", "t"], "h": None}, ["s"]), ("b", None, ["u"]), ("c", {"g": ["v"]}, None)], "cohort string, donors map<string,array<string>>, hypermutators array<string>")
    own = explode(rows)
    assert "Union" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, own.collect())) == [("a", "s"), ("a", "s"), ("a", "t"), ("b", "u"), ("c", "v")]


def test_weighted_draw_makes_fifty_draws_a_row(spark, view):
    weights = defaultdict(list)
    for gene, context, rate in sorted(view("fx_rates", "gene", "context", "rate")):
        weights[gene].append((context, int(rate * 100 + 0.5)))
    want = Counter()
    for gene, n in Counter(g for (g,) in view("fx_muts", "gene")).items():
        ends = list(accumulate(w for _, w in weights[gene]))
        for draw in range(1, 50 * n + 1):
            u = int(hashlib.md5(f"{gene}|{draw}|1".encode()).hexdigest()[:8], 16) / 2**32
            want[gene, weights[gene][bisect_right(ends, u * ends[-1])][0]] += 1
    assert sum(want.values()) == 50 * len(view("fx_muts", "gene"))
    assert {(r.gene, r.context): r.n for r in QUERIES["weighted_draw"](spark, FOLDER).collect()} == want


def test_training_table_takes_every_region_and_draw(spark, monkeypatch):
    seen = {}
    whole = training.build_training_table
    monkeypatch.setattr(training, "build_training_table", lambda t, **options: seen.update(t, **options) or whole(t, **options))
    QUERIES["build_training_table"](spark, FOLDER)
    assert seen["regions"].count() == Tables(spark, FOLDER)["fx_clusters"].count() and seen.get("per_row", 50) == 50


def test_counted_training_rows_are_the_single_rows(spark, monkeypatch):
    seen, whole, known = {}, training.build_training_table, training.site_features
    monkeypatch.setattr(training, "WIDE_BIN", 64)
    monkeypatch.setattr(intervals.occupied, "__defaults__", (64,))
    monkeypatch.setattr(training, "build_training_table", lambda t, **options: seen.update(t=t, rows=whole(t, **options)) or seen["rows"])
    QUERIES["build_training_table"](spark, FOLDER)
    rows = seen["rows"]
    ttypes = json.loads(rows.schema["drawn"].metadata["ttypes"])
    of = [c for c in rows.columns if c != "drawn"]
    each = rows.select(*of, F.explode(F.arrays_zip(F.array(*[F.lit(v) for v in ttypes]).alias("ttype"), F.col("drawn").alias("n"))).alias("d"))
    got = each.select(*of, F.col("d.ttype").alias("ttype"), F.col("d.n").alias("n")).groupBy("ttype", *of).agg(F.sum("n").alias("n")).filter("n > 0")
    single = whole(seen["t"]).groupBy("ttype", *of).agg(F.count("*").alias("n"))
    assert got.exceptAll(single).isEmpty() and single.exceptAll(got).isEmpty() and got.filter("CLUSTL = 2 or smRegions = 2").count() > 0
    # Sites where no table has anything do not meet the tables.
    asked = {}
    monkeypatch.setattr(training, "site_features", lambda sites, t, **options: asked.update(n=sites.count()) or known(sites, t, **options))
    monkeypatch.setattr(training, "build_training_table", whole)
    QUERIES["build_training_table"](spark, FOLDER)
    assert 0 < asked["n"] < rows.select(*training.SITE).distinct().count() / 2


def test_mean_attribution_explains_every_row_by_every_member(spark, monkeypatch):
    monkeypatch.setitem(QUICK, "rounds", 3)
    folder, seen, explain = "/root/testdata/sf0.01", {}, model.tree_attribution
    monkeypatch.setattr(model, "tree_attribution", lambda rows, nodes, *a, **b: seen.update(nodes=nodes, found=explain(rows, nodes, *a, **b)) or seen["found"])
    got = {r.id: r for r in QUERIES["mean_attribution"](spark, folder).collect()}
    rows = Tables(spark, folder)["fx_scored"].select("grp", "id").collect()
    assert set(got) == {r.id for r in rows} and all(got[r.id].gene == r.grp for r in rows)
    members = Counter(r.gene for r in seen["nodes"].select("gene", "split").distinct().collect())
    by = defaultdict(list)
    for r in seen["found"].collect():
        by[r.id].append(r)
    for k, own in by.items():
        assert len({r.split for r in own}) == len(own) == members[got[k].gene]
        assert sum(got[k][f"attr_{f}"] for f in MODEL_FEATURES) == pytest.approx(sum(r.margin - r.base for r in own) / len(own), abs=1e-9)
