"""Code compression against plain loops, whitening against a dense eigensolver."""

import hashlib
import random

import numpy as np
import pytest

from drivescore.llm import codebooks, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, dim int, code string, n int"
BAD = [None, [1.0, None, 0.0, 0.0], [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0]]


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", 1, 2, "b", 3) for i, v, y in rows], SCHEMA)


def plain_codes(rows, rounds, entries, scale=1024):
    """Codes by a search of all entries."""
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = -(-len(kept[0][1]) // 4)
    cut = lambda x: [(x + [0] * (4 * width))[p * width : (p + 1) * width] for p in range(4)]
    parts = [cut(x) for _, x, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[parts[k][p] for k in first] for p in range(4)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            mine = [near(x[p], books[p])[1] for x in parts]
            groups = [[x[p] for x, m in zip(parts, mine, strict=True) if m == e] for e in range(len(books[p]))]
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(groups, books[p], strict=True)]
    seal = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(x[p], books[p]) for p in range(4)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        labels[y] = labels.get(y, 0) + e
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, labels[y], seal) for (i, _, y), f, e in zip(kept, found, errors, strict=True))


def codes(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize(("dim", "entries"), [(8, 16), (6, 5), (4, 300)])
def test_codes(spark, dim, entries):
    rng = random.Random(dim)
    rows = [(k, [rng.gauss(0, 0.01) for _ in range(dim)], rng.choice([None, 1, 2])) for k in rng.sample(range(1000), 150)]
    rows += [(2000 + k, [round(rng.random()) / 1024 for _ in range(dim)], 3) for k in range(40)]  # many ties
    rows += [(rows[0][0], rows[1][1], 1), rows[2], (None, rows[3][1], None), (None, [0.5] * dim, 9)]
    bad = [(5000 + k, v and (v + [0.0] * dim)[:dim], 1) for k, v in enumerate(BAD)]
    assert codes(codebooks.compress(table(spark, rows + bad), rounds=3, entries=entries)) == plain_codes(rows, 3, entries)


def test_nearest_is_exact_beyond_doubles():
    rng = np.random.default_rng(2)
    for top in (3, 1000, 1 << 26):
        x, book = rng.integers(-top, top, (700, 5)), rng.integers(-top, top, (90, 5))
        book[40:50] = book[:10]
        index, distance = codebooks.nearest(x, book)
        for k in range(0, 700, 7):
            want = min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[k], e, strict=True)), at) for at, e in enumerate(book))
            assert (distance[k], index[k]) == want


def test_codes_of_odd_tables(spark):
    assert codebooks.compress(table(spark, [])).count() == 0
    assert codebooks.compress(table(spark, [(k, v, 1) for k, v in enumerate(BAD)])).count() == 0
    two = [(1, [0.1] * 4, 1), (2, [0.2] * 8, 1), (3, [], 1), (4, [0.3] * 8, None)]
    got = {r.vec_id: r for r in codebooks.compress(table(spark, two)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and all(r.error == 0 for r in got.values()) and got[4].code == "01010101"
    with pytest.raises(ValueError, match="beyond"):
        codebooks.compress(table(spark, [(1, [1e30] * 4, 1)]))


def plain_white(rows, k=4):
    x = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for _, v in rows])
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = ((fit - mean) ** 2).sum() / n
    s = [int(c) for c in fit.sum(0)]
    return n, (x - mean) @ vectors / np.sqrt(values), values / total, [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


@pytest.mark.parametrize(("dim", "many", "spread"), [(24, 300, 1.0), (40, 60, 0.97), (3, 50, 0.5), (20, 15, 1.0)])
def test_whitening(spark, dim, many, spread):
    rng = np.random.default_rng(dim)
    scales = 0.4 * spread ** np.arange(dim)
    rows = [(int(i), (rng.standard_normal(dim) * scales + 3).tolist()) for i in rng.permutation(many)]
    rows += [rows[0], (7, rows[1][1])] + [(9000 + k, rows[2][1]) for k in range(20)]
    given = [(i, v, 1) for i, v in rows] + [(8000 + k, v and (v + [0.0] * dim)[:dim], 1) for k, v in enumerate(BAD)]
    got = whitening.whiten(table(spark, given)).collect()
    n, white, explained, deviation = plain_white(rows)
    k = min(4, dim)
    assert len(got) == k * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    for c in range(k):
        mine = {}
        for r in got:
            if r.component == c + 1:
                mine.setdefault(r.vec_id, []).append(r)
        sign = 0
        for (i, _), w, d in zip(rows, white[:, c], deviation, strict=True):
            near = min(mine[i], key=lambda r: abs(abs(r.whitened) - abs(w)))
            sign = sign or np.sign(near.whitened * w)
            assert abs(near.whitened - sign * w) < 1e-9 and any(int(r.deviation) == d for r in mine[i]) and abs(near.explained - explained[c]) < 1e-12


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    one = whitening.whiten(table(spark, [(1, [0.5] * 6, 1), (2, [0.5] * 6, 1), (None, [0.5] * 6, 1)])).collect()
    assert len(one) == 12 and all(r.n == 1 and r.whitened is None and r.explained == 0 and r.deviation == 0 for r in one)
    line = whitening.whiten(table(spark, [(k, [k / 4, k / 4, 1.0, 0.0, 0.0], 1) for k in range(9)])).collect()
    assert all((r.whitened is not None) == (r.component == 1) for r in line) and abs(max(r.explained for r in line) - 1) < 1e-12
    both = whitening.whiten(table(spark, [(1, [0.1, 0.2], 1), (2, [0.3, 0.1], 1), (3, [0.5], 1), (4, [0.7], 1), (5, [], 1)])).collect()
    assert sorted((r.vec_id, r.component) for r in both) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
    large = whitening.whiten(table(spark, [(k, [k * 1000.0, -k * 7000.0, 1.0, k * k * 10.0], 1) for k in range(900)])).filter("component = 1 and vec_id = 0").first()
    x = [[256000 * k, -1792000 * k, 256, 2560 * k * k] for k in range(900)]
    assert int(large.deviation) == sum((900 * a - sum(c)) ** 2 for a, c in zip(x[0], zip(*x, strict=True), strict=True))
