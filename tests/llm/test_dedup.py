"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from drivescore.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, run int, fp string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "y") for i, t in rows], SCHEMA)


def texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    out = [(k, " ".join(rng.choices(words, k=rng.randint(5, 80)))) for k in range(60)]
    out += [(100 + k, out[3][1]) for k in range(40)]
    out += [(200 + k, out[4][1] + " " * k) for k in range(5)]
    out += [(300 + k, out[5][1] + f" extra{k}") for k in range(5)]
    out += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "One"), (405, "one two"), (406, "long " * 30000)]
    out += [(7, out[7][1]), (None, out[8][1]), (None, "alone")]
    return out


def test_exact_dedup(spark):
    rows = texts()
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = sorted((hashlib.sha256(k.encode()).hexdigest(), str(i), str(min(v)[2]), len(v)) for k, v in groups.items() for _, _, i in v)
    assert sorted((r.text_sha256, str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_empty_and_filter(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    rows = texts()
    left = exact_dedup.drop_exact_copies(table(spark, rows))
    assert left.columns == table(spark, rows).columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hash_is_sparks(spark):
    x = spark.sql("select xxhash64('ab cd ef') h").first().h % 2**64
    assert x == xxh64_intdigest(b"ab cd ef", 42)


def components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(fps))]


def test_bk_components():
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for centre in list(fps)[:4]:
        for _ in range(150):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randint(0, 20)
            fps.add(x)
    fps = sorted(fps)
    got = simhash.bk_components(np.array(fps, np.uint64))
    assert got.tolist() == components(fps)


def test_simhash_groups(spark):
    rows = texts()
    got = simhash.simhash_groups(table(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = components(fps)
    low = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    want = sorted((str(i), f"{f:016x}", str(low.get(c))) for (i, _), f, c in zip(rows, fps, comp))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.simhash_groups(table(spark, [])).count() == 0


def test_large_shards_are_exact(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << rng.randint(0, 63) for _ in range(k)) & (2**64 - 1) for k in range(1, 5) for _ in range(60)}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [(r.a, r.b) for r in simhash.near_links(nodes, large=3).collect()]
    whole = components([f % 2**64 for f in fps])
    at = {f: k for k, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert ((a ^ b) % 2**64).bit_count() > 0
        parent[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
    assert [find(k) for k in range(len(fps))] == whole


def test_near_copies_go_by_row(spark):
    """Null and repeated ids: exactly one row of each component stays, and no row of another goes with it."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    t, other, third = (" ".join(rng.choices(words, k=60)) for _ in range(3))
    rows = [(1, t), (None, t), (None, other), (5, t), (5, third)]
    left = simhash.drop_near_copies(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("1", t), ("None", other), ("5", third)])
    rows = [*texts(), *texts()[:20], (None, None), (None, texts()[0][1]), *rows]
    comp = components([plain_fingerprint(x) for _, x in rows])
    left = simhash.drop_near_copies(table(spark, rows))
    assert left.columns == table(spark, rows).columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    group = {(i, x): c for (i, x), c in zip(rows, comp, strict=True)}
    assert sorted(group[r] for r in got) == sorted(set(comp))
    for i, x in got:
        own = [j for (j, _), c in zip(rows, comp, strict=True) if c == group[i, x]]
        assert i == min((j for j in own if j is not None), default=None)
    assert simhash.drop_near_copies(table(spark, [])).count() == 0


def test_exact_copies_go_by_row(spark):
    rows = [*texts(), *texts()[:20], (None, None), (1, "other text"), (1, "other  text"), (None, texts()[0][1])]
    left = [(r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(table(spark, rows)).collect()]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]", "", x or "")
    want = {}
    for i, x in rows:
        key = (-len(x or ""), i is None, i or 0)
        want[norm(x)] = min(want.get(norm(x), (key, i)), (key, i), key=lambda v: v[0])
    assert sorted((norm(x), str(i)) for i, x in left) == sorted((k, str(v[1])) for k, v in want.items())
