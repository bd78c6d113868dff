"""Boosters over blocks equal those of one task; compiled forests and Shapley values equal plain walks and enumerations."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from drivescore.operators import boosting, forest

FEATURES = ["x", "y", "w"]


def rows(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=n), np.round(rng.normal(size=n), 1)
    w = rng.integers(0, 3, n).astype(float)
    label = (x + (y > 0.3) + 0.5 * (w == 2) + rng.normal(scale=0.5, size=n) > 0.6).astype(int)
    out = []
    for k in range(n):
        key = ("big", None) if k % 3 else ("small", k % 2)
        out.append((*key, k, "test" if k % 4 == 0 else "train", int(label[k]), None if k % 11 == 0 else float(x[k]), float("nan") if k % 13 == 0 else float(y[k]), float(w[k])))
    out += [("one", 1, n + k, "train", 1, 0.5, 0.5, 0.0) for k in range(40)] + [("tiny", 1, n + 50 + k, "train", k % 2, None, 0.5, 0.0) for k in range(4)]
    return out


SCHEMA = "kind string, part int, id int, role string, label int, x double, y double, w double"


@pytest.mark.parametrize(("task_rows", "patience"), [(100, 3), (150, 50)])
def test_large_keys_give_the_same_trees(spark, monkeypatch, task_rows, patience):
    monkeypatch.setattr(boosting, "FRESH", 2)
    df = spark.createDataFrame(rows(), SCHEMA)
    grow = lambda most: boosting.boosted_nodes(df, ["kind", "part"], FEATURES, "id", "label", "role", 5, 0.3, patience, 3, most)
    whole, dealt = grow(10_000), grow(task_rows)
    at = [c for c in whole.columns]
    tuples = lambda f: sorted((tuple(r[c] for c in at) for r in f.collect()), key=str)
    found = tuples(whole)
    assert {r[0] for r in found} == {"big", "small", "tiny"} and any(r[at.index("feature")] >= 0 for r in found)
    assert tuples(dealt) == found


def test_table_of_one_task_equals_rows_in_memory(spark):
    data = [r for r in rows() if r[0] == "big"]
    nodes = boosting.boosted_nodes(spark.createDataFrame(data, SCHEMA), ["kind"], FEATURES, "id", "label", "role", 4, 0.2, 9, 4).orderBy("tree", "node").collect()
    to = lambda role: (np.array([[np.nan if v is None else v for v in r[5:]] for r in data if r[3] == role]), np.array([r[4] for r in data if r[3] == role], float))
    (x, y), (t, q) = to("train"), to("test")
    trees, base, curve = boosting.fit_booster(x, y, t, q, 4, 0.2, 9, 4)
    plain = [(k, n, int(r[0]), int(r[2]), int(r[3])) for k, tree in enumerate(trees) for n, r in enumerate(tree)]
    assert [(r.tree, r.node, r.feature, r.left_node, r.right_node) for r in nodes] == plain
    assert [r.value for r in nodes] == [r[4] for tree in trees for r in tree] and nodes[0].base_margin == base
    assert [r.threshold for r in nodes] == [r[1] for tree in trees for r in tree]


def test_keys_of_one_task_are_cut_there(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_large", lambda *_: pytest.fail("dealt over blocks"))
    monkeypatch.setattr(boosting, "bin_values", lambda *_: pytest.fail("cut in a pass of its own"))
    df = spark.range(70_000).selectExpr("'a' as k", "id", "if(id % 4 = 0, 'test', 'train') as role", "cast(id * 7919 % 70000 < 9000 as int) as label", "cast(id * 7919 % 70000 as double) as x", "cast(id % 3 as double) as y")
    nodes = boosting.boosted_nodes(df, ["k"], ["x", "y"], "id", "label", "role", 1, 0.3, 3, 1).collect()
    assert [(r.tree, r.node, r.feature, r.left_node, r.right_node) for r in nodes] == [(0, 0, 0, 1, 2), (0, 1, -1, -1, -1), (0, 2, -1, -1, -1)]
    assert abs(nodes[0].threshold - 9_000) < 70_000 / boosting.BINS


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_rest_of_a_pair_equals_its_own_sums(depth):
    rng = np.random.default_rng(depth)
    bins, n_cuts = rng.integers(0, 9, (3, 700)).astype(np.uint16), np.array([9, 9, 9])
    g, h = boosting.gradients(rng.normal(size=700), (rng.random(700) < 0.3).astype(float))
    tree, rows = boosting.grown_tree(bins, g, h, n_cuts, depth)
    plain, first, at = boosting.root(g.sum(), h.sum()), 0, np.zeros(700, np.int64)
    for _ in range(depth):
        many = len(plain)
        plain = boosting.grown_level(plain, first, boosting.histograms(bins, at - first, g, h, many - first), n_cuts)
        at, first = boosting.leaf_of(plain, bins), many
    assert len(tree) > 2 and np.array_equal(tree, plain)
    assert sorted(rows) == [k for k, r in enumerate(tree) if r[0] < 0] and all((at[own] == k).all() for k, own in rows.items()) and sum(map(len, rows.values())) == 700


def test_splits_are_the_best_of_all_cuts():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 3)), (rng.random(200) < 0.4).astype(float)
    x[rng.random((200, 3)) < 0.1] = np.nan
    trees, base, _ = boosting.fit_booster(x, y, x[:0], y[:0], 1, 1.0, 5, 1)
    p = 1 / (1 + np.exp(-base))
    g, h = p - y, np.full(200, p * (1 - p))
    best = -1.0
    for f in range(3):
        for cut in np.unique(x[~np.isnan(x[:, f]), f]):
            left = np.isnan(x[:, f]) | (x[:, f] < cut)
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                best = max(best, sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1))
    f, threshold = int(trees[0][0][0]), trees[0][0][1]
    left = np.isnan(x[:, f]) | (x[:, f] < threshold)
    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
    assert gain == pytest.approx(best, abs=1e-5)
    assert trees[0][1][4] == pytest.approx(-g[left].sum() / (h[left].sum() + 1), abs=1e-6)


def test_many_values_are_cut_evenly():
    v = np.arange(10_000.0)
    (cuts,) = boosting.own_cuts(v[:, None])
    assert len(cuts) == boosting.BINS and np.bincount(boosting.binned(v[:, None], [cuts])[0]).max() < 3 * 10_000 / boosting.BINS


def random_tree(rng, depth, features):
    nodes = []

    def add(level):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(rng.normal()), 0.0])
        if level < depth and (level < 2 or rng.random() < 0.8):
            left, right = add(level + 1), add(level + 1)
            nodes[at][:4] = [int(rng.integers(features)), float(np.round(rng.normal(), 1)), left, right]
            nodes[at][5] = nodes[left][5] + nodes[right][5]
        else:
            nodes[at][5] = float(rng.integers(1, 9))
        return at

    add(0)
    return np.array(nodes)


def walk(nodes, x):
    at = 0
    while nodes[at][0] >= 0:
        v = x[int(nodes[at][0])]
        at = int(nodes[at][2] if np.isnan(v) or v < nodes[at][1] else nodes[at][3])
    return nodes[at][4]


def test_compiled_forest_equals_walks(monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 64)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(150, 6)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    trees = [random_tree(rng, int(rng.integers(1, 9)), 6) for _ in range(40)]
    trees += [np.column_stack((t[:, :4], rng.normal(size=len(t)), t[:, 5])) for t in trees[:25]]  # the same questions, other values
    made = forest.Forest.of(trees, 0.25, 6)
    assert len(made.starts) == 41
    assert np.allclose(made.margins(x), [0.25 + sum(walk(t, r) for t in trees) for r in x], atol=1e-12)
    assert forest.Forest.of([], 0.5, 6).margins(x).tolist() == [0.5] * 150


def enumerated(nodes, x, n_features):
    def value(known, at=0):
        f, threshold, left, right, v, _ = nodes[at]
        if f < 0:
            return v
        pair = (int(left), int(right))
        if int(f) in known:
            return value(known, pair[0] if np.isnan(x[int(f)]) or x[int(f)] < threshold else pair[1])
        return sum(nodes[c][5] * value(known, c) for c in pair) / sum(nodes[c][5] for c in pair)

    out = np.zeros(n_features)
    for f in range(n_features):
        rest = [k for k in range(n_features) if k != f]
        for size in range(n_features):
            for s in combinations(rest, size):
                out[f] += factorial(size) * factorial(n_features - size - 1) / factorial(n_features) * (value({*s, f}) - value({*s}))
    return out, value(set())


@pytest.mark.parametrize("depth", [1, 4, 7])
def test_shapley_equals_enumeration(depth):
    rng = np.random.default_rng(depth)
    for _ in range(6):
        nodes = random_tree(rng, depth, 5)
        x = np.round(rng.normal(size=(6, 5)), 1)
        x[0, 0] = np.nan
        out = np.zeros((6, 5))
        base = forest.tree_shapley(nodes, x, out)
        for r, got in zip(x, out, strict=True):
            want, expected = enumerated(nodes, r, 5)
            assert np.allclose(got, want, atol=1e-9) and base == pytest.approx(expected)


def test_shapley_of_deep_trees_adds_up():
    rng = np.random.default_rng(4)
    nodes, x = random_tree(rng, 10, 12), rng.normal(size=(300, 12))
    out = np.zeros((300, 12))
    base = forest.tree_shapley(nodes, x, out)
    assert np.allclose(base + out.sum(1), [walk(nodes, r) for r in x], atol=1e-8)


def test_shapley_values_of_alike_rows_are_found_once(monkeypatch):
    rng = np.random.default_rng(5)
    nodes, x = random_tree(rng, 3, 3), np.round(rng.normal(size=(20_000, 3)), 2)
    x[::7, 1] = np.nan
    found, plain = [], forest._shapley
    monkeypatch.setattr(forest, "_shapley", lambda n, x, out: found.append(len(x)) or plain(n, x, out))
    out, want = np.zeros(x.shape), np.zeros(x.shape)
    base = forest.tree_shapley(nodes, x, out)
    assert base == plain(nodes, x, want) and np.allclose(out, want, atol=1e-12)
    assert max(found) <= 2**7
