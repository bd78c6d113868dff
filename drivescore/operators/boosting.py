"""Boosted trees for the logistic loss, grown level by level from gradient histograms.

Values are binned once by cuts between a key's distinct values, at most ``BINS`` of them. Gradients are whole multiples of 2^-26, so
that their sums are exact whatever the order, and a key gives the same trees in one task as over many (of features with thousands of distinct
values, the cuts over many tasks come from a sketch, and may lie some ranks beside those of one task):

* keys of at most ``TASK_ROWS`` rows are grown where their rows meet, which cuts them as well;
* larger keys are cut into blocks of about so many rows, each of which is one row of a table that holds its bins as bytes. A level is
  one pass: blocks meet the key's tree so far, give their histograms by (node, feature, bin), whose sums go to the choice of the level's splits. No
  task holds more than some blocks, or the histograms of one key's level. Margins are written anew every ``FRESH`` trees; between, the
  trees since then are applied in the pass.

Trees are tables with a row for each node, in the order of levels: feature (-1 in leaves), threshold, left, right, value, cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivescore.sources.tables import scratch, written

BINS = 256
BINS_ROOM = BINS + 1
SCALE = float(1 << 26)
TASK_ROWS = 262_144
FRESH = 16
REG, MIN_CHILD, LEAST_GAIN = 1.0, 1.0, 1e-9
# Columns of a tree under growth.
FEATURE, CUT, LEFT, RIGHT, GRADIENT, CURVATURE = range(6)
NODES = "tree int, node int, feature int, threshold double, left_node int, right_node int, value double, cover double, base_margin double, logloss double"


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def cuts_between(values: np.ndarray) -> np.ndarray:
    """Cuts of rising distinct values: the first value, which parts missing values from the others, and the middles between neighbours."""
    middle = (values[:-1] + values[1:]) / 2
    return np.concatenate((values[:1], np.where(middle > values[:-1], middle, values[1:])))


def own_cuts(x: np.ndarray) -> list[np.ndarray]:
    """The cuts of each column of ``x`` by the rule of ``bin_values``."""
    out = []
    for column in x.T:
        v = np.unique(column[~np.isnan(column)])
        if len(v) >= BINS:
            v = v[np.unique(np.maximum(np.ceil(np.arange(BINS) / (BINS - 1) * len(v)).astype(int) - 1, 0))]
        out.append(cuts_between(v))
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(feature, row): the number of the feature's cuts at or below each value; 0 where it is missing."""
    out = np.zeros((len(cuts), len(x)), np.uint16)
    for k, c in enumerate(cuts):
        out[k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(c, x[:, k], "right"))
    return out


def bin_values(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, cuts): for each feature of a key at most ``BINS`` of its distinct values, evenly spaced among them; as an array by feature."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("v")) for k, f in enumerate(features)]))
    distinct = rows.select(*keys, each.alias("e")).filter("e.v is not null and not isnan(e.v)").select(*keys, "e.f", "e.v").distinct()
    shares = F.array(*[F.lit(k / (BINS - 1)) for k in range(BINS)])
    per = distinct.groupBy(*keys, "f").agg(F.percentile_approx("v", shares, 10_000).alias("v"))
    return per.groupBy(*keys).agg(F.collect_list(F.struct("f", F.array_sort(F.array_distinct("v")).alias("v"))).alias("cuts"))


def cuts_of(packed, n_features: int) -> list[np.ndarray]:
    out = [np.empty(0)] * n_features
    for e in packed if packed is not None else []:
        out[e["f"]] = cuts_between(np.array(e["v"], float))
    return out


def gradients(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(z)
    return np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE)


def losses(z: np.ndarray, y: np.ndarray) -> float:
    """Sum of the rows' log losses, each a whole multiple of 1 / SCALE."""
    q = np.clip(sigmoid(z), 1e-15, 1 - 1e-15)
    return float(np.rint(-(y * np.log(q) + (1 - y) * np.log(1 - q)) * SCALE).sum())


def histograms(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """(2, node, feature, bin): sums of g and h; rows of node -1 are left out."""
    live = np.flatnonzero(node >= 0)
    many = nodes * BINS_ROOM
    place = node[live].astype(np.int64) * BINS_ROOM
    out = np.zeros((2, nodes, len(bins), BINS_ROOM))
    for f, b in enumerate(bins):
        at = place + b[live]
        for k, w in enumerate((g, h)):
            out[k, :, f] = np.bincount(at, w[live], many).reshape(nodes, BINS_ROOM)
    return out


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``histograms`` of one node that has all rows."""
    return np.array([[[np.bincount(b, w, BINS_ROOM) for b in bins]] for w in (g, h)]).reshape(2, 1, len(bins), BINS_ROOM)


def best_splits(hist: np.ndarray, g: np.ndarray, h: np.ndarray, n_cuts: np.ndarray) -> list[tuple[int, int, float, float] | None]:
    """(feature, cut, g and h to its left) of each node's largest gain, the first of equal ones; of sums (2, node, feature, bin)."""
    width = int(n_cuts.max(initial=0))
    if not width or not len(g):
        return [None] * len(g)
    gl, hl = np.cumsum(hist[..., :width], 3) / SCALE
    gs, hs = (v[:, None, None] / SCALE for v in (g, h))
    fits = (np.arange(width) < n_cuts[:, None]) & (hl >= MIN_CHILD) & (hs - hl >= MIN_CHILD)
    gain = np.where(fits, gl**2 / (hl + REG) + (gs - gl) ** 2 / (hs - hl + REG) - gs**2 / (hs + REG), -1.0).reshape(len(g), -1)
    out: list[tuple[int, int, float, float] | None] = []
    for k, best in enumerate(gain.argmax(1).tolist()):
        f, cut = divmod(best, width)
        out.append((f, cut, float(gl[k, f, cut] * SCALE), float(hl[k, f, cut] * SCALE)) if gain[k, best] > LEAST_GAIN else None)
    return out


def grown_level(tree: np.ndarray, first: int, hist: np.ndarray, n_cuts: np.ndarray) -> np.ndarray:
    """``tree`` with the splits of its nodes from ``first`` on, whose histograms are (2, node, feature, bin)."""
    fresh, many = [], len(tree)
    tree = tree.copy()
    for k, found in enumerate(best_splits(hist, tree[first:, GRADIENT], tree[first:, CURVATURE], n_cuts), first):
        if found:
            f, cut, gl, hl = found
            tree[k, :4] = f, cut, many + len(fresh), many + len(fresh) + 1
            fresh += [[-1, 0, -1, -1, gl, hl], [-1, 0, -1, -1, tree[k, GRADIENT] - gl, tree[k, CURVATURE] - hl]]
    return np.concatenate((tree, np.array(fresh).reshape(-1, 6)))


def root(g: float, h: float) -> np.ndarray:
    return np.array([[-1, 0, -1, -1, g, h]])


def leaf_rows(tree: np.ndarray, bins: np.ndarray) -> dict[int, np.ndarray]:
    """The rows that have come to each leaf of ``tree``. Nodes stand after those above them."""
    rows = {0: np.arange(bins.shape[1])}
    for k, (f, cut, left, right) in enumerate(tree[:, :4].astype(np.int64).tolist()):
        if f >= 0:
            own = rows.pop(k)
            above = bins[f, own] > cut
            rows[left], rows[right] = own[~above], own[above]
    return rows


def leaf_of(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node of ``tree`` that each row has come to."""
    at = np.zeros(bins.shape[1], np.int64)
    for k, own in leaf_rows(tree, bins).items():
        at[own] = k
    return at


def grown_tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n_cuts: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """A tree of rows in memory, and the rows of each of its leaves. Of two nodes that part a node's rows the one with fewer is counted; the
    other has what is left of that node's sums, which are exact."""
    tree, first, rows, hist = root(g.sum(), h.sum()), 0, {0: np.arange(len(g))}, histogram(bins, g, h)
    for level in range(depth):
        many, below = len(tree), []
        tree = grown_level(tree, first, hist, n_cuts)
        for k in range(first, many):
            f, cut, left, right = tree[k, :4].astype(np.int64).tolist()
            if f >= 0:
                own = rows.pop(k)
                above = bins[f, own] > cut
                rows[left], rows[right] = own[~above], own[above]
                if level + 1 < depth:
                    fewer = min(left, right, key=lambda n: len(rows[n]))
                    counted = histogram(bins[:, rows[fewer]], g[rows[fewer]], h[rows[fewer]])
                    rest = hist[:, k - first : k - first + 1] - counted
                    below += [counted, rest] if fewer == left else [rest, counted]
        if not below:
            break
        hist, first = np.concatenate(below, 1), many
    return tree, rows


def values_of(tree: np.ndarray, rate: float) -> np.ndarray:
    return -tree[:, GRADIENT] / (tree[:, CURVATURE] + REG * SCALE) * rate


def node_table(tree: np.ndarray, cuts: list[np.ndarray], rate: float) -> np.ndarray:
    """(feature, threshold, left, right, value, cover) of a finished tree."""
    threshold = [cuts[int(f)][int(c)] if f >= 0 else 0.0 for f, c in tree[:, [FEATURE, CUT]]]
    return np.column_stack((tree[:, FEATURE], threshold, tree[:, LEFT], tree[:, RIGHT], values_of(tree, rate), tree[:, CURVATURE] / SCALE))


def start_margin(ones: float, n: float) -> float:
    share = float(np.clip(ones / n, 1e-6, 1 - 1e-6))
    return float(np.log(share / (1 - share)))


def boost(bins: np.ndarray, y: np.ndarray, bins_test: np.ndarray, y_test: np.ndarray, n_cuts: np.ndarray, rounds: int, rate: float, patience: int, depth: int) -> tuple[list[np.ndarray], float, list[float]]:
    """Trees under growth up to the round of least test log loss, the margin that they start from, and the loss after every round."""
    base = start_margin(y.sum(), len(y))
    z, z_test, trees, curve, best = np.full(len(y), base), np.full(len(y_test), base), [], [], (np.inf, 0)
    for k in range(rounds):
        g, h = gradients(z, y)
        tree, rows = grown_tree(bins, g, h, n_cuts, depth)
        value = values_of(tree, rate)
        trees.append(tree)
        for margins, leaves in ((z, rows), (z_test, leaf_rows(tree, bins_test))):
            for n, own in leaves.items():
                margins[own] += value[n]
        curve.append(losses(z_test, y_test) / SCALE / len(y_test) if len(y_test) else 0.0)
        if curve[-1] < best[0] - 1e-12:
            best = (curve[-1], k + 1)
        elif k + 1 - best[1] >= patience:
            break
    return trees[: max(1, best[1])], base, curve


def fit_booster(x: np.ndarray, y: np.ndarray, x_test: np.ndarray, y_test: np.ndarray, rounds: int, rate: float, patience: int, depth: int) -> tuple[list[np.ndarray], float, list[float]]:
    """Node tables, the margin that they start from, and the learning curve, of rows in memory."""
    cuts = own_cuts(x)
    trees, base, curve = boost(binned(x, cuts), y, binned(x_test, cuts), y_test, np.array([len(c) for c in cuts]), rounds, rate, patience, depth)
    return [node_table(t, cuts, rate) for t in trees], base, curve


def matrix(table: pa.Table, columns: list[str]) -> np.ndarray:
    """(row, column) of numbers; NaN where they are missing."""
    return np.column_stack([table[c].to_numpy().astype(float, copy=False) for c in columns])


def node_rows(columns: list) -> pa.Table:
    """Node rows of keys by number: _key, and the columns of ``NODES`` in their order."""
    kinds = {"int": pa.int32(), "double": pa.float64()}
    fields = [("_key", pa.int64()), *((n, kinds[kind]) for n, kind in (c.split() for c in NODES.split(", ")))]
    return pa.Table.from_arrays([pa.array(np.asarray(c).astype(kind.to_pandas_dtype(), copy=False), kind) for c, (_, kind) in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _small(features: list[str], label: str, rounds: int, rate: float, patience: int, depth: int):
    def fit(rows: pa.Table) -> pa.Table:
        train = rows["_train"].to_numpy()
        x, y = matrix(rows, features), matrix(rows, [label])[:, 0]
        if len(np.unique(y[train])) < 2:
            return node_rows([[]] * (1 + len(NODES.split(", "))))
        trees, base, curve = fit_booster(x[train], y[train], x[~train], y[~train], rounds, rate, patience, depth)
        sizes, nodes = [len(tree) for tree in trees], np.concatenate(trees)
        key = np.full(len(nodes), rows["_key"][0].as_py())
        return node_rows([key, np.repeat(np.arange(len(trees)), sizes), np.concatenate([np.arange(n) for n in sizes]), *nodes.T, np.full(len(nodes), base), np.repeat(curve[: len(trees)], sizes)])

    return fit


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _tree(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float64).reshape(-1, 6)


def _pack(features: list[str], label: str, role: str):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        train = (rows[role] == "train").to_numpy(np.uint8)
        x = rows[features].to_numpy(float)
        return pd.DataFrame([(key[0], key[1], len(rows), _bytes(x), _bytes(rows[label].to_numpy(np.uint8)), _bytes(train))], columns=["_key", "_block", "n", "x", "y", "train"])

    return pack


def _to_bins(n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bins = binned(np.frombuffer(r["x"]).reshape(r["n"], n_features), cuts_of(r["cuts"], n_features))
                yield pa.RecordBatch.from_pylist([{"_key": r["_key"], "n": r["n"], "bins": _bytes(bins), "y": r["y"], "train": r["train"], "z": _bytes(np.full(r["n"], r["base"]))}], pa.schema(BLOCK))

    return run


BLOCK = [("_key", pa.int64()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("train", pa.binary()), ("z", pa.binary())]
BLOCK_SCHEMA = "_key long, n int, bins binary, y binary, train binary, z binary"
STATE = [("_key", pa.int64()), ("base", pa.float64()), ("best", pa.float64()), ("best_round", pa.int32()), ("last", pa.float64()), ("recent", pa.list_(pa.binary())), ("tree", pa.binary()), ("first", pa.int32()), ("done", pa.bool_()), ("n_cuts", pa.list_(pa.int32()))]
STATE_SCHEMA = "_key long, base double, best double, best_round int, last double, recent array<binary>, tree binary, first int, done boolean, n_cuts array<int>"


def _block(r: dict, rate: float, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels, whether rows train, and margins with the trees since they were written."""
    bins = np.frombuffer(r["bins"], np.uint16).reshape(n_features, r["n"])
    z = np.frombuffer(r["z"]).copy()
    for t in map(_tree, r["recent"]):
        z += values_of(t, rate)[leaf_of(t, bins)]
    return bins, np.frombuffer(r["y"], np.uint8).astype(float), np.frombuffer(r["train"], np.uint8) == 1, z


def _gather(rate: float, n_features: int, level: int):
    """Histogram rows (_key, node, feature, bin, g, h) of blocks with their key's state; node -1 has the test loss and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bins, y, train, z = _block(r, rate, n_features)
                out = []
                if not level:
                    test = ~train
                    out.append(np.array([[-1], [0], [0], [losses(z[test], y[test])], [test.sum()]]))
                g, h = gradients(z[train], y[train])
                own = bins[:, train]
                at = leaf_of(_tree(r["tree"]), own) - r["first"] if level else np.zeros(own.shape[1], np.int64)
                many = int(at.max(initial=-1)) + 1
                hist = histograms(own, at, g, h, max(many, 0))
                node, f, k = np.nonzero(hist.any(0))
                out.append(np.stack((node, f, k, hist[0, node, f, k], hist[1, node, f, k])))
                cells = np.concatenate(out, 1)
                columns = [pa.array(np.full(cells.shape[1], r["_key"])), *(pa.array(cells[i].astype(np.int32)) for i in range(3)), *(pa.array(cells[i].astype(np.int64)) for i in (3, 4))]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "node", "feature", "bin", "g", "h"])

    return run


def _advance(level: int, depth: int, patience: int, round_: int, rounds: int):
    """State rows with their key's summed cells (packed) to state rows after the level's splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                cells = np.array([[c["node"], c["feature"], c["bin"], c["g"], c["h"]] for c in r.pop("cells") or []], float).reshape(-1, 5)
                inner = cells[cells[:, 0] >= 0]
                if not level:
                    r["first"], r["last"] = 0, None
                    if round_:
                        loss, n = cells[cells[:, 0] < 0][0, 3:]
                        r["last"] = loss / SCALE / n if n else 0.0
                        if r["last"] < r["best"] - 1e-12:
                            r["best"], r["best_round"] = r["last"], round_
                        elif round_ - r["best_round"] >= patience:
                            r["done"] = True
                    r["done"] = r["done"] or round_ >= rounds
                    # Each row is in one bin of the first feature, so that its sums are the root's.
                    r["tree"] = _bytes(root(*inner[inner[:, 1] == 0][:, 3:].sum(0)))
                if not r["done"]:
                    tree, n_cuts = _tree(r["tree"]), np.array(r["n_cuts"])
                    hist = np.zeros((2, len(tree) - r["first"], len(n_cuts), BINS_ROOM))
                    node, f, k = inner[:, :3].astype(int).T
                    hist[0, node, f, k], hist[1, node, f, k] = inner[:, 3], inner[:, 4]
                    r["tree"], r["first"] = _bytes(grown_level(tree, r["first"], hist, n_cuts)), len(tree)
                    if level == depth - 1:
                        r["recent"] = [*r["recent"], r["tree"]]
                yield pa.RecordBatch.from_pylist([r], pa.schema(STATE))

    return run


def _refresh(rate: float, n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                z = _block(r, rate, n_features)[3]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in BLOCK} | {"z": _bytes(z)}], pa.schema(BLOCK))

    return run


def _named(rate: float, n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = node_table(_tree(r["tree"]), cuts_of(r["cuts"], n_features), rate)
                m = len(t)
                ints = lambda a: pa.array(np.asarray(a).astype(np.int32))
                columns = [pa.array(np.full(m, r["_key"])), ints(np.full(m, r["tree_no"])), ints(np.arange(m)), ints(t[:, 0]), pa.array(t[:, 1]), ints(t[:, 2]), ints(t[:, 3]), pa.array(t[:, 4]), pa.array(t[:, 5])]
                columns += [pa.array(np.full(m, r["base"])), pa.array(np.full(m, r["loss"]))]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", *[c.split()[0] for c in NODES.split(", ")]])

    return run


def _large(rows: DataFrame, cuts: DataFrame, features: list[str], row_id: str, label: str, role: str, rounds: int, rate: float, patience: int, depth: int, task_rows: int) -> DataFrame:
    """Node rows of keys that are larger than a task: one pass over their blocks for each level."""
    spark, n_features, depth = rows.sparkSession, len(features), max(1, depth)
    block = F.pmod(F.xxhash64(row_id), F.ceil(F.col("_n") / task_rows)).cast("int")
    packed = rows.withColumn("_block", block).groupBy("_key", "_block").applyInPandas(_pack(features, label, role), "_key long, _block int, n int, x binary, y binary, train binary")
    ones = rows.filter(F.col(role) == "train").groupBy("_key").agg(F.sum(F.col(label).cast("double")).alias("ones"), F.count("*").alias("many")).filter("ones > 0 and ones < many")
    base = F.udf(lambda ones, n: start_margin(ones, n), "double")  # once for each key
    known = written(ones.select("_key", base("ones", F.col("many").cast("double")).alias("base")).join(cuts, "_key", "left"), "known")
    blocks = written(packed.join(known, "_key").select("_key", "n", "x", "y", "train", "cuts", "base").mapInArrow(_to_bins(n_features), BLOCK_SCHEMA), "blocks")
    lengths = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda k: F.coalesce(F.element_at(F.map_from_arrays("cuts.f", F.transform("cuts.v", F.size)), k), F.lit(0)))
    state = written(known.selectExpr("_key", "base", "cast('infinity' as double) as best", "0 as best_round", "cast(null as double) as last", "cast(array() as array<binary>) as recent", "cast('' as binary) as tree", "0 as first", "false as done", "cuts").withColumn("n_cuts", lengths).drop("cuts"), "state")
    path, state_columns = scratch(spark, "trees"), [k for k, _ in STATE]
    for k in range(rounds + 1):
        for level in range(depth):
            live = state.filter("not done")
            cells = blocks.join(live, "_key").mapInArrow(_gather(rate, n_features, level), "_key long, node int, feature int, bin int, g long, h long")
            sums = cells.groupBy("_key", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            lists = sums.groupBy("_key").agg(F.collect_list(F.struct("node", "feature", "bin", "g", "h")).alias("cells"))
            moved = live.join(lists, "_key", "left").select(*state_columns, "cells").mapInArrow(_advance(level, depth, patience, k, rounds), STATE_SCHEMA)
            state = written(moved.unionByName(state.filter("done").withColumn("last", F.lit(None).cast("double"))), "state")
            if not level:
                # The loss of the round before is known now.
                state.filter("last is not null").select("_key", F.lit(k - 1).alias("tree_no"), F.col("last").alias("loss")).write.parquet(f"{path}/loss/{k}")
                if state.filter("not done").isEmpty():
                    break
        live = state.filter("not done")
        if live.isEmpty():
            break
        live.select("_key", F.lit(k).alias("tree_no"), "tree").write.parquet(f"{path}/tree/{k}")
        if (k + 1) % FRESH == 0:
            blocks = written(blocks.join(live, "_key").mapInArrow(_refresh(rate, n_features), BLOCK_SCHEMA), "blocks")
            state = written(state.withColumn("recent", F.array().cast("array<binary>")), "state")
    trees = spark.read.schema("_key long, tree_no int, tree binary").parquet(f"{path}/tree/*")
    loss = spark.read.schema("_key long, tree_no int, loss double").parquet(f"{path}/loss/*")
    best = state.select("_key", F.greatest(F.lit(1), "best_round").alias("best_round"))
    kept = trees.join(best, "_key").filter("tree_no < best_round").join(loss, ["_key", "tree_no"]).join(known, "_key")
    return kept.select("_key", "tree_no", "tree", "cuts", "base", "loss").mapInArrow(_named(rate, n_features), f"_key long, {NODES}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys in as many partitions as a shuffle has. Rows are few bytes but much work, so that Spark, which joins small partitions by
    their bytes, is told the number."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def boosted_nodes(df: DataFrame, keys: list[str], features: list[str], row_id: str, label: str, role: str, rounds: int, rate: float, patience: int, depth: int, task_rows: int | None = None) -> DataFrame:
    """(keys, node columns, logloss): the node rows of each key's booster, with the test log loss after its tree.

    Keys whose training rows hold one label give none. ``task_rows`` bounds the rows that one task holds.
    """
    task_rows = task_rows or TASK_ROWS
    rows = written(df.select(*keys, row_id, role, F.col(label).cast("int").alias(label), *[F.col(f).cast("double").alias(f) for f in features]), "boosted_rows")
    named = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_key", F.monotonically_increasing_id()), "boosted_keys")
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(named[k])
    numbered = rows.join(named, same).select("_key", "_n", row_id, role, label, *features)
    small = numbered.filter((F.col("_n") <= task_rows) & F.col(role).isin("train", "test")).select("_key", (F.col(role) == "train").alias("_train"), label, *features)
    out = spread(small, "_key").groupBy("_key").applyInArrow(_small(features, label, rounds, rate, patience, depth), f"_key long, {NODES}")
    if not named.filter(F.col("_n") > task_rows).isEmpty():
        rows = numbered.filter(F.col("_n") > task_rows)
        cuts = written(bin_values(rows.filter(F.col(role) == "train"), ["_key"], features), "cuts")
        large = _large(rows, cuts, features, row_id, label, role, rounds, rate, patience, depth, task_rows)
        out = out.unionByName(large)
    return out.join(named.drop("_n"), "_key").select(*keys, *[c.split()[0] for c in NODES.split(", ")])
