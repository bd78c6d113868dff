"""MinHash near-duplicates against brute force over all pairs."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from drivescore.llm import minhash

SCHEMA = "doc_id long, text string, lang string, row long, n string, band int, node int, id string, component_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", 2, 3, "y", 4) for i, t in rows], SCHEMA)


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def plain(rows, words=2, num=80, den=100):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted((str(i), len(sets[k]), str(ids.get(find(k))), i == ids.get(find(k))) for k, (i, _) in enumerate(rows))


def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    out = [(k, " ".join(rng.choices(words, k=rng.randint(3, 60)))) for k in range(40)]
    base = rng.choices(words, k=40)
    for k in range(60):  # a group whose members are about 0.8 alike
        own = list(base)
        for at in rng.sample(range(40), 2):
            own[at] = rng.choice(words)
        out.append((100 + k, " ".join(own)))
    out += [(200 + k, out[5][1].upper()) for k in range(30)]
    out += [(300 + k, f"{out[6][1]} more{k}") for k in range(5)]
    chain = rng.choices(words, k=60)
    out += [(400 + k, " ".join(chain[k : k + 30])) for k in range(0, 30, 2)]
    out += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "One"), (505, "one two"), (506, "two one"), (507, "café Été"), (508, "café été")]
    out += [(600, "long " * 20000), (601, "long long"), (602, " ".join(f"x{k}" for k in range(20000))), (603, " ".join(f"x{k}" for k in range(19500)))]
    out += [(7, out[7][1]), (7, "other text here"), (None, out[8][1]), (None, "alone of all"), (None, "alone of all")]
    return out


def answers(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


@pytest.mark.parametrize("block", [minhash.BLOCK, 150])
def test_against_all_pairs(spark, block):
    rows = corpus()
    got = minhash.minhash_groups(table(spark, rows), words=2, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert answers(got) == plain(rows)


def test_five_words_by_default(spark):
    rows = corpus()
    assert answers(minhash.minhash_groups(table(spark, rows))) == plain(rows, 5)


def test_empty(spark):
    assert minhash.minhash_groups(table(spark, [])).count() == 0
    assert minhash.minhash_groups(table(spark, [(1, None), (2, "")])).filter("kept and n_shingles = 0").count() == 2


def test_blocks_find_links_that_leaders_miss(spark):
    # The leader is like neither of two sets that are like each other; pieces of one shingle force all ways to meet.
    sets = {1: range(0, 20), 2: range(10, 30), 3: range(11, 31), 4: range(12, 32), 5: range(100, 120)}
    members = spark.createDataFrame([(9, k, 2 if k == 3 else k, 20) for k in sets], "block long, node long, comp long, n long")
    held = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, shingles array<long>")
    for most in (1_000_000, 20, 40):
        found = {tuple(sorted((r.a, r.b))) for r in minhash.block_links(members, held, Fraction("0.8"), most).collect()}
        assert found and found <= {(2, 4), (3, 4)}


def test_linked_joins_all_that_are_alike():
    rng = random.Random(9)
    sets = []
    for _ in range(12):
        base = rng.sample(range(5000), 50)
        sets += [np.array(sorted({*base[: rng.randint(40, 50)], *rng.sample(range(5000), rng.randint(0, 6))}), np.uint64) for _ in range(8)]
    comp = np.arange(len(sets))
    one = np.zeros(len(sets), int)
    found = minhash.linked(sets, comp, one, Fraction("0.8"))
    want = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert set(found) <= set(want) and roots(found, len(sets)) == roots(want, len(sets))
    assert len(found) == len(sets) - len(set(roots(want, len(sets))))


def roots(pairs, n):
    at = list(range(n))
    for a, b in pairs * 2:
        low = min(at[a], at[b])
        at = [low if x in (at[a], at[b]) else x for x in at]
    return at


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for n, common in ((9, 8), (90, 80), (900, 800)):
        agree = []
        for _ in range(150):
            base = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = minhash.signatures([base[:n], base[n - common :]])
            agree.append((a == b).reshape(minhash.BANDS, minhash.WIDTH).all(1).sum())
        j = common / (2 * n - common)
        assert abs(np.mean(agree) - minhash.BANDS * j**minhash.WIDTH) < 1.5 and min(agree) > 0
