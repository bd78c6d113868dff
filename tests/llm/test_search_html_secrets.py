"""Top-k search, page extraction and secret scans against brute force."""

import hashlib
import math
import random
import re

import numpy as np

from drivescore.llm import html_extract, secret_scan, topk


def test_topk(spark):
    rng = random.Random(1)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)], 1, "x") for k in range(230)]
    rows += [(300 + k, rows[0][1], 1, "x") for k in range(8)]
    rows += [(400, None, 1, "x"), (450, [float("nan")] * 6, 1, "x"), (500, [None] * 6, 1, "x"), (550, [float("inf")] + [0.0] * 5, 1, "x"), (600, [1e12] * 6, 1, "x"), (None, rows[1][1], 1, "x"), (100, rows[100][1], 1, "x"), (650, [0.5], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int, dim string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(df).collect()]
    vectors = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for own, (q, a) in enumerate(vectors):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for at, (c, b) in enumerate(vectors) if at != own and len(a) == len(b))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best) if -(2**63) <= -s < 2**63]
    small = [g for g in got if g[0] != 600 and g[2] != 600]
    assert sorted(small) == sorted(w for w in want if w[0] != 600 and w[2] != 600)
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_tile_sizes_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(k), rng.normal(size=4).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = sorted(map(tuple, topk.exact_topk(df, every=10).collect()))
    monkeypatch.setattr(topk, "TILE", 40)
    monkeypatch.setattr(topk, "QUERY_BYTES", 500)
    assert sorted(map(tuple, topk.exact_topk(df, every=10, fan=3).collect())) == one


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (7, [0.1, 0.0]), (7, [0.9, 0.0]), (8, [0.5, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect())
    assert got == [(50, 1, 7, 230 * 256), (50, 2, 8, 128 * 256), (100, 1, 100, 65536), (100, 1, 100, 65536), (100, 2, 7, 0), (100, 2, 7, 0)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h2>Site</h2></header>
<nav><ul><li><a href="/a">Home page link</a></li><li>More</li></ul></nav><div class="ad">Buy this thing now</div>
<div class="cookie-notice">We use cookies</div><aside id="sidebar"><p>Popular posts here</p></aside>
<article><h1>A &amp; B</h1><p>One <b>two</b>
 three.<br>four<script>var x="</p>";</script></p><form><input name=q><label>Mail us</label></form><p title="a > b">caf&eacute; &#x41;</p>
<div class="share">Share it</div></article>
<section class="comments"><p>Nice post, I like it a lot</p></section><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    text = "A & B\n\nOne two three. four\n\ncafé A"
    assert html_extract.main_text(PAGE) == text
    plain = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    assert html_extract.main_text(plain) == text
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p>open <b", "t"), (5, "u", "<article>" + "<p>long words here</p>" * 20_000, "t"), (1, "u", PAGE, "t"), (6, "u", "<nav>only menu</nav>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert html_extract.extract(df).count() == len(rows)
    assert got[1].text == text and got[1].n_chars == len(text)
    assert got[2].text == got[3].text == got[6].text == "" and got[2].url is None
    assert got[4].text == "open"
    assert got[5].text == "\n\n".join(["long words here"] * 20_000)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_best_region():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def test_trigram_queries_are_necessary():
    for rule, texts in ((secret_scan.RULES[0], ["API_KEY: 'x'", 'passwd = "abc"', "Token:x"]), (secret_scan.RULES[1], ["AKIA" + "B" * 12]), (secret_scan.RULES[4], ["ghp_" + "a" * 36])):
        for t in texts:
            assert re.search(rule.pattern, t, re.I)
            assert any(all(g in t.lower() for g in s) for s in secret_scan.trigram_query(rule.pattern))
    assert secret_scan.trigram_query("[0-9a-f]{32,}") == [frozenset()]
    assert secret_scan.trigram_query("(abc|abd)+x?") == [frozenset({"abc"}), frozenset({"abd"})]


def plain_spans(text):
    base = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 0, 16), ("hex", "[0-9a-f]+", 0, 0, 32))
    out = []
    for k, (name, pattern, flags, group, least) in enumerate(base):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(7)
    bits = ["password=", "Secret: ", "token = ", 'api_key="', "APIKEY:'", "AKIA", "abcdef12", "deadbeef" * 4, "ABCDEFGH12345678", " ", "é", "日", ".", "\n", "passwd:short", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20]
    rows = [(k, "".join(rng.choices(bits, k=rng.randint(0, 25))), "x") for k in range(300)]
    rows += [(900, None, "x"), (901, "", "x"), (902, "a " * 60_000 + "token=12345678", "x"), (1, rows[1][1], "x"), (None, "secret=abcdefgh", "x"), (903, "password: token = abcdefgh123", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.secret_scan(df).collect())
    want = []
    for i, t, _ in rows:
        s = plain_spans(t or "")
        n = [sum(x[1] == k for x in s) for k in range(3)]
        want.append((str(i), *n, hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in s).encode()).hexdigest()))
    assert got == sorted(want)
    spans = {r.doc_id: r.spans for r in secret_scan.secret_scan(df).collect()}
    for i, t, _ in rows[:300]:
        assert ("github:" in spans[i]) == bool(re.search("gh[pousr]_[A-Za-z0-9]{36,}", t))
    assert secret_scan.secret_scan(df.limit(0)).count() == 0


def test_wrapper_named_like_boilerplate_and_comment_articles():
    page = '<body><div class="page has-sidebar"><div class="sidebar">Links here</div><main><h1>Title</h1><p>Body text of the page.</p></main><div class="comments"><article class="comment"><p>I disagree with all of it</p></article></div></div></body>'
    assert html_extract.main_text(page) == "Title\n\nBody text of the page."


def test_lists_and_leads_of_unmarked_pages_stay(spark):
    nav = "<nav><ul>" + "<li><a href='/x'>Menu entry of the site</a></li>" * 9 + "</ul></nav>"
    marked = [(k, "u", f"<body>{nav}<article><h1>Title</h1><p>{'plain words of content ' * 9}</p></article></body>") for k in range(12)]
    body = "<p>A short lead.</p>" + "<div class='ad'><ul>" + "<li>Buy it now and here</li>" * 20 + "</ul></div><ul><li>First point</li><li>Second point</li></ul>" + f"<p>{'more words ' * 60}</p>"
    page = f"<body>{nav}<div class='post'>{body}</div></body>"
    df = spark.createDataFrame([*marked, (99, "u", page)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[99] == "A short lead.\n\nFirst point\n\nSecond point\n\n" + " ".join(["more words"] * 60)
    assert got[0] == "Title\n\n" + " ".join(["plain words of content"] * 9)


def test_sections_named_in_part_like_boilerplate_stay_in_marked_content():
    page = "<body><main><p>Body text.</p><section id='related-work'><p>Earlier results.</p></section><div class='related'><p>Read this too</p></div></main></body>"
    assert html_extract.main_text(page) == "Body text.\n\nEarlier results."
