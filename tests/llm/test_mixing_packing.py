"""Mixing and packing against plain computations."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from drivescore.llm import mixing, packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, src long, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "b") for i, t, s in rows], SCHEMA)


def corpus():
    rng = random.Random(3)
    words = ["alpha", "Beta,", "naïve", "x1", "don't", "<|endoftext|>", "日本", "É́", "a\tb", "---", "\x1c"]
    rows = []
    for k in range(200):
        s = "hot" if k % 3 == 0 else f"s{k % 7}"
        rows.append((k, " ".join(rng.choices(words, k=rng.randint(0, 300))), s))
    rows += [(500, "word " * 9000, "s1"), (501, None, "s2"), (502, "", None), (503, "one two", None), (503, "one two", None), (None, "x y z", "s1"), (504, "tiny", "aa")]
    return rows


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def test_mix(spark):
    rows = corpus()
    df = mixing.mix_sources(table(spark, rows))
    got = df.collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    took = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= max(2, 0.01 * want[s]), (s, took[s], want[s])
    again = mixing.mix_sources(table(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(table(spark, [])).count() == 0
    assert mixing.mix_sources(table(spark, [(1, None, "a")])).collect()[0].taken == 0


def spark_hash(*values):
    """Spark's xxhash64 of (kind, value) columns: i for int, l for long; nulls are passed over."""
    import struct

    from xxhash import xxh64_intdigest

    h = 42
    for kind, v in values:
        if v is not None:
            h = xxh64_intdigest(struct.pack("<i" if kind == "i" else "<q", v), h)
    return h - 2**64 if h >= 2**63 else h


def test_mix_equals_a_plain_block_mix(spark):
    """Every document's taken words: blocks of its source's stream, each as often as the permutations name it."""
    rng, seed = random.Random(12), mixing.SEED
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", None])) for k in range(60)] + [(None, "x y z", "a"), (7, "w w", "b"), (900, None, "a")]
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    names = ["a", "b", None]
    want = Counter()
    for src, name in enumerate(names, 1):
        own = sorted(((spark_hash(("l", i), ("i", seed)) % 64, i is None, i or 0, size(t), i) for i, t, s in rows if s == name))
        total = sizes[name]
        length = max(1, min(64, -(-total // 1000)))
        blocks = -(-total // length)
        quota = min(3 * blocks, int(targets(sizes)[name] * blocks / total + 0.5))
        copies = Counter()
        for j in range(quota):
            x, key = j % blocks, (("i", seed), ("l", src), ("l", j // blocks))
            for r in range(1, mixing.ROUNDS + 1):
                other = (spark_hash(("i", r), ("l", blocks), *key) % blocks - x) % blocks
                if spark_hash(("l", max(x, other)), ("i", r), *key) & 1:
                    x = other
            copies[x] += 1
        at = 0
        for *_, n, i in own:
            want[i, name, n, sum(copies[w // length] for w in range(at, at + n))] += 1
            at += n
    got = mixing.mix_sources(table(spark, rows), shard_slots=100).collect()
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == want


def test_permutation_is_bijective(spark):
    for n in (1, 2, 7, 64, 1001):
        x = spark.range(n).select(mixing.permuted(mixing.F.col("id"), mixing.F.lit(n).cast("long"), mixing.F.lit(9)).alias("x"))
        assert sorted(r.x for r in x.collect()) == list(range(n))


def test_mixed_documents(spark):
    rows = corpus()
    out = mixing.mixed_documents(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    assert set(Counter((r.doc_id, r.text) for r in out.collect()).values()) <= {1, 2, 3, 4, 6}


def test_pack(spark):
    rows = corpus()
    got = packing.best_fit_pack(table(spark, rows), TOKENIZER).collect()
    tk, want = Tokenizer.from_file(TOKENIZER), Counter()
    for i, t, _ in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            p = ids[k : k + 4096]
            want[i, k // 4096, k, len(p), zlib.crc32(p.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert packing.best_fit_pack(table(spark, []), TOKENIZER).count() == 0


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_plan():
    rng = random.Random(8)
    for case in range(60):
        cap = rng.choice([10, 64, 1000])
        items = [min(cap, max(1, int(rng.expovariate(1 / (cap * rng.choice([0.05, 0.2, 0.5])))))) for _ in range(rng.randint(0, 400))]
        h = Counter(items)
        rows, ranks = [], defaultdict(set)
        for n, first, many, seq, off in packing.plan_packing(dict(h), cap):
            for k in range(many):
                ranks[n].add(first + k)
                rows.append((seq + k, off, n))
        assert len(rows) == len(items) and all(ranks[n] == set(range(c)) for n, c in h.items())
        bins = check_sequences(rows, cap)
        plain = []
        for n in sorted(items, reverse=True):
            fits = [k for k in range(len(plain)) if plain[k] >= n]
            if fits:
                plain[min(fits, key=plain.__getitem__)] -= n
            else:
                plain.append(cap - n)
        assert bins <= len(plain) * 1.02 + 1, (case, bins, len(plain))


def test_every_letter_before_punctuation():
    tk, encoder = Tokenizer.from_file(TOKENIZER), packing.WordEncoder(TOKENIZER)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    assert {"İ", "য়", "ढ़"} <= set(letters)
    words = [f"x{c}{tail}" for c in letters for tail in (",", '."')] + ["হয়,", "xİ,", "बढ़,", "बढ़,"]
    got = dict(zip(words, encoder.encode(words), strict=True))
    want = dict(zip(words, (np.array(e.ids, "<u4").tobytes() for e in tk.encode_batch(words, add_special_tokens=False)), strict=True))
    assert [w for w in words if got[w] != want[w]] == []
