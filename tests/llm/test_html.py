"""Page extraction against a brute-force version, and pages that the linear scan alone can tell apart."""

import random
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from drivescore.llm import html_extract as H

WEIGHTS = H.Weights(names={".ad": -4.0, "<nav>": -4.0, "<footer>": -4.0, ".post": 2.0}, tags={"li": -1.0}, link=-1.0)
# What the names of the random pages mean.
BOILERPLATE = {".ad", ".share", ".comments", ".user-comments", ".ad-slot", ".alert", "#alert"}
NEVER_WRAPS = {".ad", ".comments", ".user-comments", ".ad-slot"}
WHOLE = lambda scores: (0, len(scores))  # noqa: E731  the scan taken out


class Plain(HTMLParser):
    """Words and tags of a well-formed page with the chain of (tag, names) around each; all parts by plain recursion."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.chain, self.rows, self.link, self.mute = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in H.SKIPPED:
            self.mute += 1
        if tag == "a":
            self.link += 1
        if tag in H.CONTAINERS:
            names = [("@" if k == "role" else "." if k == "class" else "#") + x for k, v in attrs if k in ("class", "id", "role") for x in v.split()]
            self.chain = [*self.chain, (tag, tuple(names), len(self.rows))]
        if not self.mute or tag in H.SKIPPED:
            self.rows.append(("start", tag, self.chain, self.link > 0))

    def handle_endtag(self, tag):
        if tag in H.SKIPPED:
            self.mute -= 1
            return
        if tag == "a":
            self.link -= 1
        if not self.mute:
            self.rows.append(("end", tag, self.chain, self.link > 0))
        if tag in H.CONTAINERS:
            self.chain = self.chain[:-1]

    def handle_data(self, data):
        if not self.mute:
            self.rows.append(("text", data, self.chain, self.link > 0))


def plain_text(page, w):
    p = Plain()
    p.feed(page)
    p.close()
    chains = {tuple(r[2]) for r in p.rows} | {tuple(r[2][:k]) for r in p.rows for k in range(len(r[2]))}
    chains.discard(())
    words = {c: sum(len(r[1].split()) for r in p.rows if r[0] == "text" and tuple(r[2][: len(c)]) == c) for c in chains}
    total = sum(len(r[1].split()) for r in p.rows if r[0] == "text")

    def flow(chain):
        return flow(chain[:-1]) if chain and chain[-1][0] in H.FLOWING else tuple(chain)

    texts = {}
    for k, (kind, v, chain, _) in enumerate(p.rows):
        if kind == "text" and v.split():
            texts.setdefault(flow(chain), []).append(k)

    def title(chain):
        tag, names, begin = chain[-1]
        if tag != "header" or len(chain) < 2 or chain[-2][0] == "body" or any("site" in n for n in names):
            return False
        below = [r for r in p.rows if tuple(r[2][: len(chain)]) == tuple(chain)]
        menus = any(t in ("nav", "form", "menu") for r in below for t, _, _ in r[2][len(chain) :])
        return not menus and any(r[0] == "start" and r[1] in H.HEADINGS for r in below) and any(k > begin for k in texts.get(flow(chain[:-1]), []))

    def set_in(chain):
        near = texts.get(flow(chain[:-1]), [])
        return chain[-2][0] in H.FLOWING or chain[-1][0] != "footer" and any(k < chain[-1][2] for k in near) and any(k > chain[-1][2] for k in near)

    def named(n, tag, inside, head):
        if n[0] == "@":
            return n[1:] in H.BAD_ROLES
        if n == "#alert" and tag == "section" and inside:
            return False
        return n in BOILERPLATE or n == "#site-header" and not head

    def link_word(at):
        """Score of a word in a link, by all words of its block."""
        a = b = at
        while a > 0 and not (p.rows[a][0] != "text" and p.rows[a][1] in H.BLOCKS):
            a -= 1
        while b < len(p.rows) and not (p.rows[b][0] != "text" and p.rows[b][1] in H.BLOCKS):
            b += 1
        n = sum(len(r[1].split()) for r in p.rows[a:b] if r[0] == "text")
        m = sum(len(r[1].split()) for r in p.rows[a:b] if r[0] == "text" and r[3])
        links = sum(r[:2] == ("start", "a") for r in p.rows[a:b])
        if p.rows[a][:2] == ("start", "p") and m >= H.SENTENCE * links:
            return w.word
        return m / n * w.link + (1 - m / n) * w.word if n else w.link

    def state(chain, neutral):
        """(own, weight, inside, content) of the last element of the chain."""
        if not chain:
            return None, None, False, False
        _, above, inside, _ = state(chain[:-1], neutral)
        tag, names, _ = chain[-1]
        own = None
        if chain not in neutral:
            head = inside or title(chain)
            tells = tag in H.TELLING and not (tag == "header" and head)
            odds = [w.names[f] for f in [*names, *([f"<{tag}>"] if tells else [])] if f in w.names]
            if tells or any(named(n, tag, inside, head) for n in names):
                odds.append(H.PRIOR)
            own = min(odds) if odds else None
        dark = above is not None and above < 0
        content = (tag in H.CONTENT or "@main" in names) and not dark and (own is None or own >= 0)
        if content:
            return H.LIMIT, H.LIMIT, True, True
        return own, above if own is None or dark else own, inside, False

    def bars(chain):
        return any(t in ("nav", "aside", "footer") for t, _, _ in chain)

    first = {c: state(c, set()) for c in chains}
    can = lambda c: first[c][0] is not None and first[c][0] < 0 and c[-1][0] not in ("nav", "aside", "footer") and not NEVER_WRAPS & set(c[-1][1])
    neutral = {c for c in chains if c[-1][0] in H.FORMS and can(c) and words[c] >= 0.5 * total}
    if not any(s[3] for s in first.values()):
        marks = [c for c in chains if (c[-1][0] in H.CONTENT or "@main" in c[-1][1]) and not bars(c[:-1]) and (first[c][0] is None or first[c][0] >= 0)]
        neutral |= {c for c in chains if can(c) and (words[c] >= H.WRAPPER * total or any(len(m) > len(c) and m[: len(c)] == c for m in marks))}
    last = {c: state(c, neutral) for c in chains} | {(): (None, None, False, False)}
    marked = any(s[3] for s in last.values())
    values = []
    for at, (kind, v, chain, link) in enumerate(p.rows):
        own, weight, inside, _ = last[tuple(chain)]
        bad = weight is not None and weight < 0
        if kind == "text":
            values.append(len(v.split()) * (0.0 if bad else -w.word if marked and not inside and weight is None else link_word(at) if link and not inside else w.word))
        elif not bad:
            values.append(w.tag(v))
        elif kind == "start" and v == chain[-1][0] and not inside and (last[tuple(chain[:-1])][1] or 0) >= 0:
            values.append(-5 * H.LIMIT if v in H.PARTING and not set_in(chain) else own / 2)
        else:
            values.append(0.0)
    best, begin, end = 0.0, 0, 0
    for a in range(len(values)):
        for b in range(a + 1, len(values) + 1):
            if sum(values[a:b]) > best + 1e-9:
                best, begin, end = sum(values[a:b]), a, b
    out = [""]
    for kind, v, chain, _ in p.rows[begin:end]:
        weight = last[tuple(chain)][1]
        if kind == "text" and (weight is None or weight >= 0):
            out[-1] += v
        elif kind != "text" and v in H.BLOCKS:
            out.append("")
        elif kind != "text" and v in H.SPACES:
            out[-1] += " "
    return "\n\n".join(t for t in (" ".join(x.split()) for x in out) if t)


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.random()
        words = " ".join(rng.choices(["one", "two", "a&amp;b", "&lt;x&gt;", "caf&eacute;", "\n", "four"], k=rng.randint(1, 9)))
        if kind < 0.4 or depth > 3:
            block = rng.choice(["p", "p", "p", "h2"])
            parts.append(f"<{block}>{words}</{block}>" if rng.random() < 0.7 else words)
        elif kind < 0.5:
            parts.append(f"<p>{words} <a href='x>y'>link {words}</a><br>end</p>")
        elif kind < 0.6:
            parts.append("<script>var t='</p>';</script>")
        else:
            tag = rng.choice(["div", "div", "section", "nav", "aside", "footer", "header", "article", "main", "form", "ul", "blockquote"])
            name = rng.choice(["", "", ' class="ad"', ' class="post"', ' id="site-header"', ' class="related-work"', ' class="share"', ' role="main"', ' class="comments x"', ' class="user-comments"', ' class="market-share"', ' class="ad-slot"', ' id="alert"'])
            parts.append(f"<{tag}{name}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(parts)


@pytest.mark.parametrize("weights", [H.Weights(), WEIGHTS])
def test_equals_brute_force(weights):
    rng = random.Random(5)
    for _ in range(400):
        page = f"<html><body>{random_page(rng)}</body></html>"
        assert H.main_text(page, weights) == plain_text(page, weights), page


def test_the_scan_decides_the_region():
    tagline = "<div><p>Welcome to the pages of our fine town</p></div>"
    unmarked = f"<body>{tagline}<nav><ul><li>Menu</li></ul></nav><div><h1>Title</h1>{'<p>plain words of the text here</p>' * 9}</div><footer>x</footer><div>Made with care by us</div></body>"
    text = "\n\n".join(["Title", *["plain words of the text here"] * 9])
    assert H.main_text(unmarked) == text
    without = H.main_text(unmarked, region=WHOLE)
    assert without.startswith("Welcome to the pages") and without.endswith("Made with care by us")
    marked = f"<body>{tagline}<div><main><h1>Title</h1><div><div><p>Body of it</p></div></div></main></div><div>Made with care</div></body>"
    assert H.main_text(marked) == "Title\n\nBody of it" != H.main_text(marked, region=WHOLE)


def test_parts_set_into_a_text():
    lead, body, close = " ".join(["lead"] * 15), " ".join(["body"] * 40), " ".join(["close"] * 13)
    for part in ("<nav class='toc'><ul><li><a>One</a></li></ul></nav>", "<aside><p>By the way</p></aside>", "<header>Part two</header>"):
        for tag in ("div", "section", "body"):
            page = f"<body><{tag}><h1>Title</h1><p>{lead}</p>{part}<p>{body}</p>{part}<p>{close}</p></{tag}></body>"
            assert H.main_text(page) == f"Title\n\n{lead}\n\n{body}\n\n{close}", page
            aside = f"<body><{tag}><p>{' '.join(['lead'] * 11)}</p>{part}<p>{body}</p></{tag}><footer>Imprint</footer></body>"
            assert H.main_text(aside) == f"{' '.join(['lead'] * 11)}\n\n{body}"
    quote = f"<body><div><p>{lead}</p><blockquote><p>Said so</p><footer>Someone</footer></blockquote><p>{close}</p></div></body>"
    assert H.main_text(quote) == f"{lead}\n\nSaid so\n\n{close}"


def test_header_with_the_title():
    body = " ".join(["body"] * 30)
    assert H.main_text(f"<body><div><header><h1>Title</h1></header><p>{body}</p></div></body>") == f"Title\n\n{body}"
    assert H.main_text(f"<body><div><header class='entry-header'><h1>Title</h1></header><p>{body}</p></div></body>") == f"Title\n\n{body}"
    for site in ("<header><h1>Site</h1></header>", "<div><header class='site-header'><h1>Site</h1></header><p>x</p></div>", "<div><header><h1>Site</h1><nav>Menu</nav></header></div>"):
        assert H.main_text(f"<body>{site}<div><p>{body}</p></div></body>").endswith(body)
        assert "Site" not in H.main_text(f"<body>{site}<div><p>{body}</p></div></body>")


def test_topics_named_like_boilerplate():
    shares, other = " ".join(["share"] * 60), " ".join(["other"] * 20)
    for name in ("market-share", "tasting-menu", "job-promotion", "heatAlert", "code-comment"):
        assert H.main_text(f"<body><div class='{name}'><p>{shares}</p></div><div><p>{other}</p></div></body>") == f"{shares}\n\n{other}"
    assert H.main_text("<body><article><h1>Title</h1><section id='alert'><h2>Alert</h2><p>Its topic</p></section></article></body>") == "Title\n\nAlert\n\nIts topic"


@pytest.mark.parametrize("name", ["user-comments", "comment-list", "comments-area", "cookie-banner", "siteCookieBar", "ad-slot", "share-buttons", "social-links", "newsletter-box", "related-content"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_boilerplate_inside_the_text(tag, name):
    body = " ".join(["body"] * 30)
    page = f"<body><{tag}><h1>Title</h1><p>{body}</p><div class='{name}'><p>Leave this out of it</p></div><p>{body}</p></{tag}></body>"
    assert H.main_text(page) == f"Title\n\n{body}\n\n{body}"


def test_long_comments_never_wrap_the_text():
    comments = "".join(f"<article class='comment-body'><p>{'chat ' * 90}</p></article>" for _ in range(9))
    for tag in ("article", "div"):
        page = f"<body><{tag}><h1>Title</h1><p>{'body ' * 40}</p></{tag}><div class='comment-list'>{comments}</div></body>"
        assert "chat" not in H.main_text(page) and H.main_text(page).startswith("Title")


def test_paragraphs_of_links():
    lines = [f"Line {k} of a poem whose verses are links" for k in range(8)]
    page = "".join(f"<p><a href='/{k}'>{x}</a></p>" for k, x in enumerate(lines))
    assert H.main_text(f"<body><div>{page}</div></body>") == "\n\n".join(lines)
    menu = "<p><a>Home</a> <a>About us</a> <a>Contact</a></p>"
    assert H.main_text(f"<body><div>{menu}</div><div>{page}</div></body>") == "\n\n".join(lines)


def test_family_of_pages_that_the_scan_decides():
    rng, told = random.Random(7), 0
    line = lambda n: " ".join(rng.choices(["river", "stone", "house", "light"], k=n))
    for _ in range(200):
        before, after = rng.randint(0, 2), rng.randint(0, 2)
        blocks = [line(rng.randint(20, 60)) for _ in range(rng.randint(2, 8))]
        part = rng.choice(["<nav class='toc'><a>One</a></nav>", "<aside>By the way</aside>", "<div class='ad'>Buy it now</div>"])
        text = part.join(f"<p>{b}</p>" for b in blocks)
        page = f"<body>{''.join(f'<div><p>{line(5)}</p></div>' for _ in range(before))}<nav><a>Home</a></nav><div><h1>Title</h1>{text}</div><footer>Imprint</footer>{''.join(f'<div><p>{line(6)}</p></div>' for _ in range(after))}</body>"
        want = "\n\n".join(["Title", *blocks])
        assert H.main_text(page) == want, page
        told += H.main_text(page, region=WHOLE) != want
    assert told > 100


def test_form_around_the_page():
    inner = "<h1>Title</h1><p>Body of the page</p><form class='x'><input><label>Mail us</label> now</form>"
    for tag in ("article", "div"):
        assert H.main_text(f'<body><form id="aspnetForm"><input type=hidden><{tag}>{inner}</{tag}></form></body>') == "Title\n\nBody of the page"


def test_names_in_part_like_boilerplate():
    for name in ("related-work", "share-price", "comment-theory", "ad-hoc"):
        page = f"<body><article><h1>Title</h1><div class='{name}'><p>Kept all the same</p></div><div class='share'>Share it</div></article></body>"
        assert H.main_text(page, WEIGHTS) == "Title\n\nKept all the same"


def test_advert_within_an_article_leaves_both_sides():
    page = f"<body><article><h1>A short lead</h1><div class='ad'>{'buy ' * 200}</div><p>{'rest ' * 90}</p></article></body>"
    for p in (page, page.replace("article", "div")):
        assert H.main_text(p, WEIGHTS) == "A short lead\n\n" + " ".join(["rest"] * 90)


def test_given_pages_keep_their_text_without_marks():
    pages = [p for p in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if p]
    for w in (H.Weights(), H.Weights(names={"<nav>": -4.0, "<footer>": -4.0, ".ad": -4.0})):
        for p in pages:
            article = re.search(r"<article>.*</article>", p, re.S)
            assert H.main_text(p, w) == H.main_text(article[0], w)
            assert H.main_text(re.sub(r"<(/?)article\b", r"<\1div", p), w) == H.main_text(p, w)


@pytest.mark.parametrize("junk", ["<a ", '<a b="', "<a b='>' ", '<a "', "</script ", "<head>", "<!-- ", "<", "<div class=\"", "<div>", "<div></ul>", "<p", "&", "<![CDATA["])
def test_a_megabyte_of_broken_markup_is_linear(junk):
    page, began = junk * (1_000_000 // len(junk)), time.process_time()
    H.main_text(page)
    assert time.process_time() - began < (1 if junk == "<a " else 12)
    assert H.main_text("<p>Words first</p>" + page[:3000]).startswith("Words first")
