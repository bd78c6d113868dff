"""Token counts, language identification and toxicity against plain recursions and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from drivescore.llm import language_id, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, label int, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 1, 0, "b") for i, t, lang in rows], SCHEMA)


def test_forward_trie():
    rng = random.Random(4)
    scores = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -rng.random() * 9 - 0.1 for _ in range(40)} | {"a": -3.0}
    trie = token_counts.ForwardTrie(scores, limit=50)
    worst = min(scores.values()) - token_counts.BYTE_PENALTY

    def plain(word):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(i):
                s = scores.get(word[j:i])
                if s is not None and best[j][0] + s > best[i][0]:
                    best[i] = (best[j][0] + s, best[j][1] + 1)
            n = len(word[i - 1].encode())
            if best[i - 1][0] + n * worst > best[i][0]:
                best[i] = (best[i - 1][0] + n * worst, best[i - 1][1] + n)
        return best[-1][1]

    for _ in range(400):
        w = "".join(rng.choices("abcdé日", k=rng.randint(0, 9)))
        assert trie.count(w) == plain(w), w


def test_token_counts(spark):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "the cat sat on the mat", "en"), (2, None, None), (3, "", "en"), (4, "日本 \x00 naïve", "x"), (4, "日本 \x00 naïve", "x"), (5, "word " * 50_000, "en"), (None, "the", "en")]
    got = {(r.doc_id, r.n_pretokens): r.n_tokens for r in token_counts.token_counts(table(spark, rows), model).collect()}
    trie = token_counts.ForwardTrie(token_counts.piece_scores(model))
    for i, t, _ in rows:
        w = (t or "").split()
        assert got[i, len(w)] == sum(trie.count("▁" + x) for x in w)
    assert token_counts.token_counts(table(spark, []), model).count() == 0


def test_kneser_ney_sums_to_one_and_matches_the_recursion():
    words = {"en": "the then thin other this", "de": "der die das dein der"}
    counts = {lang: Counter(g for w in t.split() for g in language_id.word_grams(w, 3)) for lang, t in words.items()}
    model = language_id.kneser_ney(counts, ["de", "en"], 3)
    letters = sorted(set("".join(words.values()).replace(" ", ""))) + [language_id.EDGE]

    def logp(context, c):
        gram = (context + c)[-3:]
        return -model.score_words([context[1:] + c if c != language_id.EDGE else context[1:]])[0], gram

    # Total probability of all continuations of a context, from differences of word scores.
    for prefix in ("", "t", "th", "d", "zz"):
        full = np.zeros(2)
        base = model.score_words([prefix])[0][:-1] if prefix else np.zeros(2)
        stop = {}
        for c in letters[:-1]:
            stop[c] = model.score_words([prefix + c])[0][:-1]
        # p(c | prefix) * p(end | prefix + c) is what a word's score holds; compare with the recursion.
        for c in letters[:-1]:
            want = recursion(counts, letters, prefix + c)
            assert np.allclose(stop[c], want, atol=1e-4), (prefix, c)
        assert base.shape == full.shape


def recursion(counts, letters, word, order=3):
    """Negative log likelihood of a word by the textbook interpolated Kneser-Ney recursion."""
    out = []
    for lang in ("de", "en"):
        raw = counts[lang]
        c = [{} for _ in range(order + 1)]
        for g, k in raw.items():
            if len(g) == order or len(g) > 1 and g[0] == language_id.EDGE:
                c[len(g)][g] = k
        for n in range(1, order):
            for g in {x[1:] for x in raw if len(x) == n + 1}:
                c[n][g] = sum(1 for x in raw if len(x) == n + 1 and x[1:] == g)
        discount = []
        for n in range(order + 1):
            ones, twos = sum(v == 1 for v in c[n].values()), sum(v == 2 for v in c[n].values())
            discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
        alphabet = len({g for la in counts for g in {x[1:] for x in counts[la] if len(x) == 2}}) + 1

        def p(context, x, c=c, discount=discount, alphabet=alphabet):
            n = len(context) + 1
            lower = p(context[1:], x) if context else 1 / alphabet
            mass = sum(v for g, v in c[n].items() if g[:-1] == context)
            if not mass:
                return lower
            kinds = sum(1 for g in c[n] if g[:-1] == context)
            return max(c[n].get(context + x, 0) - discount[n], 0) / mass + discount[n] * kinds / mass * lower

        seq = language_id.EDGE + word + language_id.EDGE
        out.append(-sum(math.log(p(seq[max(0, i - order + 1) : i], seq[i])) for i in range(1, len(seq))))
    return out


def test_language_id(spark):
    rng = random.Random(6)
    vocab = {"en": "the then that with from this which other there".split(), "fr": "le les des une dans être où ça mais".split()}
    rows = [(k, " ".join(rng.choices(vocab[lang], k=rng.randint(1, 40))), lang) for k in range(300) for lang in [rng.choice(["en", "fr"])]]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "123 ... !", "en"), (903, "the " * 30_000, None), (903, "the " * 30_000, None), (None, "les", "fr")]
    got = language_id.language_id(table(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:300]}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id]
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[k] for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "fr"]
    assert language_id.language_id(table(spark, [])).count() == 0
    assert [r.lang_pred for r in language_id.language_id(table(spark, [(1, "x", None)])).collect()] == ["und"]


def plain_marginals(t, x):
    u = np.column_stack([np.ones(len(x)), np.exp(t.bias + x.astype(float))])
    step = np.exp(t.moves)
    fw, bw = np.empty_like(u), np.ones_like(u)
    fw[0] = u[0] / u[0].sum()
    for k in range(1, len(u)):
        fw[k] = fw[k - 1] @ step * u[k]
        fw[k] /= fw[k].sum()
    for k in range(len(u) - 2, -1, -1):
        bw[k] = step @ (u[k + 1] * bw[k + 1])
        bw[k] /= bw[k].sum()
    p = fw * bw
    return p[:, 1] / p.sum(1)


def test_marginals_are_those_of_the_whole_chain():
    rng = np.random.default_rng(3)
    for _ in range(40):
        t = toxicity.Tagger({"bad": 3.0, "badl*": 1.0, "idio*": 2.0}, rng.normal(size=1 + len(toxicity.PREFIXES)), rng.normal(), rng.normal(size=(2, 2)))
        words = rng.choice(["plain", "bad", "badly", "idiocy", "x"], rng.integers(1, 120), p=[0.8, 0.05, 0.05, 0.05, 0.05]).tolist()
        x = t.word_weights(words)[:, 0]
        places, p = t.marginals(x)
        assert np.allclose(p, plain_marginals(t, x)[places], atol=1e-9)


def test_hidden_states_gradient():
    """The fit's gradient is that of the likelihood of the documents' labels by enumeration of all states."""
    rng = np.random.default_rng(4)
    x, doc, toxic = rng.normal(size=(4, 3, 2)), np.array([0, 0, 1, 2]), np.array([True, False, True])

    def likelihood(theta, notice=toxicity.NOTICE):
        moves = theta[3:].reshape(2, 2)
        z, u = np.ones(3), np.ones(3)
        for w in range(4):
            sums = [0.0, 0.0]
            for states in np.ndindex(2, 2, 2):
                e = sum(s * (theta[2] + x[w, t] @ theta[:2]) for t, s in enumerate(states)) + sum(moves[a, b] for a, b in zip(states, states[1:]))
                sums[0] += np.exp(e)
                sums[1] += np.exp(e) * (1 - notice) ** sum(states)
            z[doc[w]] *= sums[0]
            u[doc[w]] *= sums[1]
        r = u / z
        return float(np.where(toxic, np.log(1 - r), np.log(r)).sum())

    theta = np.concatenate(([1.0, 0.0, -4.0], np.zeros(4)))
    step = np.exp(theta[3:].reshape(2, 2))
    unary = np.exp(theta[2] + x @ theta[:2])
    (log_z, p, m), (log_u, q, missed) = toxicity.chain_sums(unary, step), toxicity.chain_sums(unary * (1 - toxicity.NOTICE), step)
    r = np.exp(np.bincount(doc, log_u - log_z, 3))
    pull = np.where(toxic, r / (1 - r), -1.0)[doc]
    more = pull[:, None] * (p - q)
    g = np.concatenate((np.einsum("wt,wtf->f", more, x), [more.sum()], pull @ (m - missed)))
    numeric = [(likelihood(theta + h) - likelihood(theta - h)) / 2e-5 for h in np.eye(7) * 1e-5]
    assert np.allclose(g, numeric, atol=1e-5)
    # By the logit of the chance of notice.
    v = toxicity.NOTICE
    near = [1 / (1 + (1 - v) / v * np.exp(-h)) for h in (1e-5, -1e-5)]
    assert np.isclose(v * (pull @ q.sum(1)), (likelihood(theta, near[0]) - likelihood(theta, near[1])) / 2e-5, atol=1e-5)
    held = toxicity.fit_chain(x, doc, toxic, rounds=60, decay=0.0, fit_notice=False)
    free = toxicity.fit_chain(x, doc, toxic, rounds=60, decay=0.0)
    value = lambda f: likelihood(np.concatenate((f[0], [f[1]], f[2].ravel())), f[3])
    assert held[3] == pytest.approx(v) and value(free) > value(held) > likelihood(theta)
    # A window twice is two windows.
    twice = toxicity.fit_chain(x[[0, 1, 2, 3, 3, 0]], doc[[0, 1, 2, 3, 3, 0]], toxic, rounds=20)
    times = toxicity.fit_chain(x, doc, toxic, rounds=20, times=np.array([2.0, 1, 1, 2]))
    assert all(np.allclose(a, b) for a, b in zip(twice, times, strict=True))


def test_windows_of_the_fit_hold_every_word_of_the_lexicon_once():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(0, 400))
        f = np.where(rng.random((n, 2)) < rng.choice([0.01, 0.2, 0.9]), rng.integers(-2, 9, (n, 2)), 0).astype(float)
        rows, times = toxicity.cover(f)
        got, want = Counter(), Counter(map(tuple, f[f.max(1) > 0])) if n else Counter()
        for r, k in zip(rows.reshape(-1, toxicity.WIDTH, 2), times, strict=True):
            for word in r[r.max(1) > 0]:
                got[tuple(word)] += int(k)
        assert got == want


def test_scores_are_those_of_all_state_sequences(spark):
    """Score, prediction and spans of whole documents by enumeration of every sequence of states."""
    rng = np.random.default_rng(6)
    t = toxicity.Tagger({"bad": 3.0, "badl*": 1.5, "idio*": 2.5, "good": -2.0}, rng.normal(1, 0.2, 1 + len(toxicity.PREFIXES)), -1.5, rng.normal(0, 0.5, (2, 2)), np.array([-2.0, 1.1, 2.0]))
    vocabulary = ["plain", "Bad!", "badly", "idiocy", "good", "--", "x"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 11))) for _ in range(60)] + ["", None, "bad", " \n bad  badly "]
    got = {r.doc_id: r for r in toxicity.score_with(table(spark, [(k, x, "en") for k, x in enumerate(texts)]), t).collect()}
    assert len(got) == len(texts)
    predicted = set()
    for k, text in enumerate(texts):
        words = list(re.finditer(r"\S+", text or ""))
        x = t.word_weights([w[0] for w in words])[:, 0].astype(float) if words else np.zeros(0)
        p, z = np.zeros(len(x)), 0.0
        for states in np.ndindex(*[2] * len(x)):
            e = np.exp(sum(s * (t.bias + v) for s, v in zip(states, x, strict=True)) + sum(t.moves[a, b] for a, b in zip(states, states[1:])))
            z += e
            p += e * np.array(states)
        p = p / z
        # Words far from any with a weight stay out of the sum, as those of a text without one.
        near = [j for j in range(len(x)) if x[max(0, j - 1) : j + 2].any()]
        p = p[near]
        score = 1 / (1 + math.exp(-(-2.0 + 1.1 * math.log1p(p.sum()) + 2.0 * (p.max() if len(p) else 0.0))))
        assert math.isclose(got[k].score, score, abs_tol=1e-6) and got[k].predicted == (got[k].score >= 0.3)
        predicted.add(got[k].predicted)
        runs = []
        for j, q in zip(near, p, strict=True):
            if q >= 0.5:
                if runs and runs[-1][2] == j - 1:
                    runs[-1] = [runs[-1][0], words[j].end(), j]
                else:
                    runs.append([words[j].start(), words[j].end(), j])
        assert [[s.start, s.end] for s in got[k].spans] == [r[:2] for r in runs]
    assert predicted == {0, 1}


def test_toxicity(spark):
    rng = random.Random(9)
    plain = [f"{a}{b}" for a in ("mel", "tor", "vin", "sap") for b in ("an", "os", "ith", "ur", "el")]
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = rng.choices(plain, k=rng.randint(10, 120))
        if bad:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["Grumble!", "snark", "lowei" + rng.choice(["an", "os", "ith", "xyz"])]))
        rows.append((k, " ".join(w), "en"))
        labels.append((k, 1, int(bad), "c"))
    rows += [(900, None, None), (901, "", "en"), (902, "mela " * 40_000 + "snark", "en"), (902, "snark", "en"), (None, "grumble", "en")]
    labels += [(5, 1, 0, "c"), (None, 1, 1, "c"), (901, 1, None, "c")]
    ldf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(table(spark, rows), ldf).collect()
    assert len(got) == len(rows)
    right = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 600:
            right += r.predicted == (r.doc_id % 4 == 0)
    assert right >= 590
    assert toxicity.toxicity(table(spark, []), ldf).count() == 0
    assert toxicity.toxicity(table(spark, rows[:3]), ldf.limit(0)).filter("predicted = 1").count() == 0
    by = {r.doc_id: r for r in got}
    shown = [rows[r.doc_id][1][x.start : x.end] for r in got if r.doc_id is not None and r.doc_id < 600 for x in r.spans]
    assert shown and sum(bool(re.search("grumble|snark|lowei", x.lower())) for x in shown) >= 0.95 * len(shown)
    assert by[900].spans == by[901].spans == []
    again = toxicity.toxicity(table(spark, rows[::-1]).repartition(3), ldf).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    left = toxicity.drop_toxic(table(spark, rows), ldf)
    assert left.columns == table(spark, rows).columns
