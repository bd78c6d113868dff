"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of words and tags. Words score positive and tags negative, by weights from
labelled pages: those that mark their own content with ``article``, ``main`` or ``role=main`` tell for
each class and id of a container, for each telling element and for links how many words lie inside that content and
outside. A container with negative log-odds is boilerplate: its words score nothing and the tag that opens it costs
by its odds. One linear scan finds the contiguous region of largest sum, and the region alone decides where
the text begins and ends: what lies outside stays out whatever its own score. Inside the region boilerplate
(an advert between two paragraphs) is left out.

Names of boilerplate enter as features: a small prior where the labelled pages say nothing. They are read by
their last part ("cookie-banner", "user-comments"); words that are as often a topic ("market-share") count alone or
with a part that names a place or the site. A form, or a container with such a name, that holds marked content or is
nearly the whole page is a wrapper and weighs nothing, but a list of comments, a menu or an advert never is one.

A menu or an aside between two paragraphs of one container ("on this page") is set into the text and parts it no
more than other boilerplate does. A ``header`` that holds a heading before text of the same container is a title.

Reading a page takes linear time, broken markup included. The weights are fitted on about ``SAMPLE_PAGES``
pages chosen by a hash; every page is then read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SAMPLE_PAGES = 4000
LEAST_PAGES = 5
LIMIT = 4.0  # bound of a log-odds weight
WRAPPER = 0.8  # share of a page's words from which on a form or named container is its wrapper
SENTENCE = 5  # words a link from which on a paragraph of links is text

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I | re.S)
FRAGMENT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements of HTML by what they mean for the text.
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "iframe", "svg", "object", "canvas", "math"}
FORMS = {"form", "button", "select", "textarea", "option", "fieldset", "dialog", "menu", "label"}
TELLING = {"nav", "header", "footer", "aside", *FORMS}
CONTENT = {"article", "main"}
CONTAINERS = {"article", "main", "section", "div", "nav", "header", "footer", "aside", "ul", "ol", "dl", "table", "body", "figure", "blockquote", "details", "address", "center", *FORMS}
BLOCKS = CONTAINERS - {"label"} | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "caption", "thead", "tbody", "tfoot", "pre", "hr", "figcaption", "hgroup", "summary", "legend", "search"}
SPACES = {"br", "td", "th", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARTING = {"nav", "header", "footer", "aside"}
#: Containers that are part of the text around them.
FLOWING = {"ul", "ol", "dl", "table", "figure", "blockquote", "details", "address", "center"}
# Priors: log-odds of containers with such a name or role, where labelled pages tell nothing else.
BAD_NAMES = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "aside", "notice", "cookie", "cookies", "consent", "gdpr", "banner", "popup",
    "modal", "overlay", "newsletter", "subscribe", "signup", "login", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment",
    "comments", "commentlist", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "alert", "disclaimer", "topbar",
    "copyright", "paywall", "teaser",
}
#: Those of them that are topics as well: they count alone, or where every other part is a place or the site.
TOPICS = {"aside", "notice", "menu", "share", "sharing", "social", "related", "recommended", "alert", "promotion", "comment", "respond", "replies", "consent", "login", "disclaimer", "copyright", "sponsor", "banner", "ad", "ads", "overlay", "widget"}
AROUND = {"site", "page", "main", "global", "primary", "secondary", "user", "reader", "post", "article", "entry", "header", "mobile", "sticky", "button", "js"}
#: Names of what never wraps the main text.
APART = {"nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "comment", "comments", "commentlist", "disqus", "respond", "replies", "ad", "ads", "advert", "adverts", "advertisement", "related", "recommended", "pagination", "pager"}
HEAD_NAMES = {"header", "topbar", "masthead"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note", "status", "toolbar"}
#: Endings of class names that say where a box stands, not what it is ("ad-slot", "sidebar-left").
PLACES = {"left", "right", "top", "bottom", "wrap", "wrapper", "container", "box", "bar", "inner", "outer", "block", "area", "slot", "list", "item", "section", "panel", "widget", "body", "content", "text", "group", "links", "buttons", "icons"}
PRIOR = -2.0


def head_word(name: str) -> str:
    """What a class or id names: its last part that is not a place ("cookie" of "site-cookieBar")."""
    parts = [p.lower() for p in FRAGMENT.findall(name)]
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    head = parts.pop() if parts else ""
    if head in TOPICS and not all(p in PLACES or p in AROUND or p in BAD_NAMES for p in parts):
        return ""
    return head


@dataclass
class Weights:
    """Log-odds of lying in content: of words by feature of their container, of words in links, and scores of tags."""

    names: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    link: float = -0.5

    def tag(self, name: str) -> float:
        return -0.05 - 0.25 * min(LIMIT, max(0.0, -self.tags.get(name, 0.0)))

    def odds(self, c: Container) -> float | None:
        """The least log-odds of the container's features; None if it has none."""
        found = [self.names[f] for f in features(c) if f in self.names]
        if c.tag != "body" and (c.tells() or any(prior(n, c) for n in c.names)):
            found.append(PRIOR)
        return min(found, default=None)


class Container:
    """An element of the page: the words below it and what they weigh."""

    __slots__ = ("above", "barred", "begin", "content", "first", "flow", "heading", "holds", "inside", "last", "menu", "names", "own", "tag", "weight", "words")

    def __init__(self, above: Container | None, tag: str, names: list[str]):
        self.above, self.tag, self.names = above, tag, names
        self.words, self.own, self.weight = 0, None, None
        self.content = self.inside = self.holds = False
        #: The container whose text this one's own text belongs to, the places of that text, and of the opening tag.
        self.flow = above.flow if above is not None and tag in FLOWING else self
        self.first = self.last = self.begin = None
        self.heading = self.menu = False
        #: Lies in an element that is never a wrapper of content.
        self.barred = above is not None and (above.barred or above.tag in ("nav", "aside", "footer"))

    def marks(self) -> bool:
        return self.tag in CONTENT or any(n[1:] in CONTENT for n in self.names if n[0] == "@")

    def title(self) -> bool:
        """A header with a heading and no menu, before text of the container that it lies in; not the page's own header."""
        up = self.above
        return self.tag == "header" and self.heading and not self.menu and up.tag not in ("", "body") and (up.flow.last or 0) > self.begin and not any("site" in n.lower() for n in self.names)

    def tells(self) -> bool:
        return self.tag in TELLING and not (self.tag == "header" and (self.inside or self.title()))

    def within(self) -> bool:
        """Lies between two texts of one container, or in a quotation or figure."""
        up = self.above
        return up.tag in FLOWING or self.tag != "footer" and up.flow.first is not None and up.flow.first < self.begin < up.flow.last

    def apart(self) -> bool:
        return self.tag in ("nav", "aside", "footer") or any(n[0] != "@" and (n[1:].lower() in APART or head_word(n[1:]) in APART) for n in self.names)


def features(c: Container) -> list[str]:
    """Whole class and id names and roles, and the tag if it tells; generic containers have no feature."""
    return [n.lower() for n in c.names if c.tag != "body"] + ([f"<{c.tag}>"] if c.tells() else [])


def prior(name: str, c: Container) -> bool:
    """Whether a class, id or role of a container names boilerplate.

    Within marked content headers are titles, and the id of a section names its topic unless it can name nothing else.
    """
    kind, bare = name[0], name[1:].lower()
    if kind == "@":
        return bare in BAD_ROLES
    word = head_word(name[1:])
    if kind == "#" and c.inside and c.tag == "section" and (bare in TOPICS or word in TOPICS):
        return False
    return bare in BAD_NAMES or word in BAD_NAMES or not (c.inside or c.title()) and (bare in HEAD_NAMES or word in HEAD_NAMES)


def tag_end(page: str, at: int, spent: dict[str, bool]) -> int:
    """Place after the ``>`` of the tag whose attributes begin at ``at``; one in a quoted value doesn't end it. 0: no end.

    Once a tag has run to the end of the page in search of one, quotes count no more, so that broken markup is not
    read again and again.
    """
    first, k = page.find(">", at) + 1, at
    while first and "quotes" not in spent:
        m = MARK.search(page, k)
        if not m:
            spent["quotes"] = True
            break
        k = m.end()
        if m[0] == ">":
            return k
        before = m.start() - 1
        while before >= at and page[before].isspace():
            before -= 1
        if before >= at and page[before] == "=" and m[0] not in spent:
            close = page.find(m[0], k)
            if close < 0:
                spent[m[0]] = True
            else:
                k = close + 1
    return first


def events(page: str) -> tuple[list[tuple[str, str, Container]], list[Container]]:
    """(kind, value, innermost container) of texts and tags in page order, and the containers, outer ones first.

    Takes time linear in the page's length.
    """
    root = Container(None, "", [])
    stack, containers, out = [root], [root], []
    opened: dict[str, int] = {}
    size, last = len(page), page.rfind(">")
    spent: dict[str, bool] = {}
    ends: dict[str, int] = {}
    begin = at = 0

    def text(stop: int) -> None:
        if stop > begin:
            out.append(("text", page[begin:stop], stack[-1]))

    def following(pattern: str) -> int:
        """Where the pattern next occurs, or the page's size; a place is looked for once."""
        if ends.get(pattern, -1) < at:
            m = re.compile(pattern, re.I).search(page, at)
            ends[pattern] = m.start() if m else size
        return ends[pattern]

    while 0 <= (at := page.find("<", at)) < size - 1:
        c = page[at + 1]
        if c in "!?":
            text(at)
            if page.startswith("<!--", at):
                stop = following("--!?>")
                stop = page.find(">", stop) + 1
            elif page.startswith("<![CDATA[", at):
                stop = page.find("]]>", at)
                out.append(("text", page[at + 9 : stop if stop >= 0 else size], stack[-1]))
                stop = stop + 3 if stop >= 0 else 0
            else:
                stop = page.find(">", at) + 1
            begin = at = stop or size
            continue
        m = TAG.match(page, at) if at < last and (c == "/" or c.isalpha()) else None
        if m:
            closing, name, attributes, stop = m[1], m[2].lower(), m[3], m.end()
        else:
            m = NAME.match(page, at) if c == "/" or c.isalpha() else None
            if not m:
                at += 1  # a plain less-than sign
                continue
            closing, name, stop = m[1], m[2].lower(), tag_end(page, m.end(), spent)
            if not stop:  # the page ends within a tag
                text(at)
                begin = size
                break
            attributes = page[m.end() : stop - 1]
        text(at)
        begin = at = stop
        if closing:
            out.append(("end", name, stack[-1]))
            while opened.get(name):
                ended = stack.pop().tag
                opened[ended] -= 1
                if ended == name:
                    break
            continue
        if name in SKIPPED:
            if not attributes.rstrip().endswith("/"):
                stop = following(rf"</{re.escape(name)}(?=[\s/>])")
                if stop < size:
                    stop = page.find(">", stop) + 1 or size
                elif name == "head":
                    stop = following(r"<body(?=[\s>])")
                    stop = stop if stop < size else at
                begin = at = stop
            out.append(("start", name, stack[-1]))
            continue
        if name in CONTAINERS:
            names = []
            if "=" in attributes:
                for key, value in ATTRIBUTE.findall(attributes):
                    names += [{"class": ".", "id": "#", "role": "@"}[key.lower()] + x for x in value.strip("\"'").split()]
            stack.append(Container(stack[-1], name, names))
            containers.append(stack[-1])
            opened[name] = opened.get(name, 0) + 1
        out.append(("start", name, stack[-1]))
    text(size)
    return out, containers


def weigh(seq: list[tuple[str, str, Container]], containers: list[Container], weights: Weights) -> bool:
    """Set each container's log-odds and whether it is or lies in marked content; True if the page marks any."""
    for k, (kind, value, c) in enumerate(seq):
        if kind == "text":
            if n := len(value.split()):
                c.words += n
                c.flow.last = k
                if c.flow.first is None:
                    c.flow.first = k
        elif kind == "start":
            if c.begin is None and value == c.tag:
                c.begin = k
            if value in HEADINGS:
                c.heading = True
    for c in reversed(containers[1:]):
        c.above.words += c.words
        c.above.heading |= c.heading
        c.above.menu |= c.menu or c.tag in ("nav", "form", "menu")

    def settle(wrappers: set[Container]) -> bool:
        found = False
        for c in containers[1:]:
            c.inside = c.above.inside
            c.own = None if c in wrappers else weights.odds(c)
            shaded = c.above.weight is not None and c.above.weight < 0
            c.content = c.marks() and not shaded and (c.own is None or c.own >= 0)
            if c.content:
                c.own, c.inside, found = LIMIT, True, True
            c.weight = c.above.weight if c.own is None or shaded else c.own
        return found

    def may_wrap(c: Container) -> bool:
        return c.own is not None and c.own < 0 and not c.apart()

    found = settle(set())
    wrappers = {c for c in containers[1:] if c.tag in FORMS and may_wrap(c) and c.words >= 0.5 * containers[0].words}
    if not found:
        # No mark stands free of boilerplate: what holds one, or nearly all words, is a wrapper whatever its name.
        for c in reversed(containers[1:]):
            if c.holds or c.marks() and not c.barred and (c.own is None or c.own >= 0):
                c.above.holds = True
            if may_wrap(c) and (c.holds or c.words >= WRAPPER * containers[0].words):
                wrappers.add(c)
    return settle(wrappers) if wrappers else found


def link_scores(seq: list[tuple[str, str, Container]], weights: Weights) -> list[float]:
    """Score of a word in a link by the block of each entry: the denser its links, the nearer to the score of a menu's.

    A paragraph whose links run on for ``SENTENCE`` words or more is text.
    """
    out: list[float] = []
    link = paragraph = False
    words = inner = links = 0

    def close() -> None:
        part = inner / words if words else 0.0
        w = weights.word if paragraph and inner >= SENTENCE * links else part * weights.link + (1 - part) * weights.word
        out.extend([w] * (k - len(out)))

    k = 0
    for k, (kind, value, c) in enumerate(seq):
        if kind == "text":
            n = len(value.split())
            words += n
            if link:
                inner += n
        elif value == "a":
            link = kind == "start"
            links += link
        elif value in BLOCKS:
            close()
            paragraph = value == "p" and kind == "start"
            words = inner = 0
            links = int(link)
    k = len(seq)
    close()
    return out


def scores(seq: list[tuple[str, str, Container]], marked: bool, weights: Weights) -> list[float]:
    """Score of each entry of the sequence: words positive, tags negative.

    Words of boilerplate weigh nothing, so that an advert parts no text by its length; the tag that opens it
    costs as much as ``-own / 2`` words, and ``5 LIMIT`` if it parts the page (nav, header, footer, aside not set into a text). On a page
    that marks its content, words elsewhere are known not to be content: they score negative.
    """
    out, link = [], False
    linked = link_scores(seq, weights)
    for k, (kind, value, c) in enumerate(seq):
        bad = c.weight is not None and c.weight < 0
        if kind == "text":
            if bad:
                w = 0.0
            elif marked and not c.inside and c.weight is None:
                w = -weights.word
            else:
                w = linked[k] if link and not c.inside else weights.word
            out.append(w * len(value.split()))
            continue
        if value == "a":
            link = kind == "start"
        if not bad:
            out.append(weights.tag(value))
        elif kind == "start" and c.tag == value and not c.inside and (c.above.weight is None or c.above.weight >= 0):
            out.append(-5 * LIMIT if value in PARTING and not c.within() else c.own / 2)
        else:
            out.append(0.0)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds (end exclusive) of the contiguous part of largest sum; the first of equals, empty if none is positive."""
    best = total = 0.0
    begin, found = 0, (0, 0)
    for k, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += s
        if total > best:
            best, found = total, (begin, k + 1)
    return found


def main_text(page: str | None, weights: Weights | None = None, region=best_region) -> str:
    """Main text of a page: blocks in page order with two line feeds between them; empty if none."""
    weights = weights or Weights()
    seq, containers = events(page or "")
    begin, end = region(scores(seq, weigh(seq, containers, weights), weights))
    blocks, now = [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, c in seq[begin:end]:
        if kind == "text":
            if c.weight is None or c.weight >= 0:
                now.append(value)
        elif value in BLOCKS:
            flush()
        elif value in SPACES:
            now.append(" ")
    flush()
    return "\n\n".join(blocks)


def tally_page(page: str, seen: dict[tuple[str, str], list[int]]) -> None:
    """Add a page that marks its content to (words or tags inside, outside, pages) by feature."""
    seq, containers = events(page)
    if not weigh(seq, containers, Weights()):
        return
    own: dict[tuple[str, str], list[int]] = {}
    inside = dict.fromkeys(map(id, containers), 0)
    link = False
    for kind, value, c in seq:
        n = len(value.split()) if kind == "text" else 0
        if c.inside:
            inside[id(c)] += n
        if kind != "text" and value == "a":
            link = kind == "start"
        # Boilerplate's own tags and links are left aside: menus would tell against all lists and links.
        if c.weight is None or c.weight >= 0:
            if kind != "text":
                own.setdefault(("tag", value), [0, 0])[not c.inside] += 1
            elif link and n:
                own.setdefault(("link", ""), [0, 0])[not c.inside] += n
    for c in reversed(containers[1:]):
        inside[id(c.above)] += inside[id(c)]
        for f in features(c) if c.words else ():
            x = own.setdefault(("name", f), [0, 0])
            x[0] += inside[id(c)]
            x[1] += c.words - inside[id(c)]
    for key, (a, o) in own.items():
        s = seen.setdefault(key, [0, 0, 0])
        s[0] += a
        s[1] += o
        s[2] += 1


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from the sampled pages that mark their content; defaults if none does."""
    n = pages.count()
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("pages")), 11) / F.lit(float(1 << 53))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for page in b.column(0):
                tally_page(page.as_py(), seen)
            ks = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in ks], pa.string()), pa.array([k[1] for k in ks], pa.string()), *(pa.array([seen[k][j] for k in ks], pa.int64()) for j in range(3))], names=["kind", "name", "a", "o", "p"])

    rows = bounded_batches(pages).filter(F.col(html_col).isNotNull() & (u * n < sample)).select(F.col(html_col).alias("h"))
    got = rows.mapInArrow(tally, "kind string, name string, a long, o long, p long").groupBy("kind", "name").agg(F.sum("a").alias("a"), F.sum("o").alias("o"), F.sum("p").alias("p"))
    out = Weights()
    for r in got.filter(F.col("p") >= LEAST_PAGES).collect():  # bounded by the sample
        odds = max(-LIMIT, min(LIMIT, math.log((r["a"] + 1) / (r["o"] + 1))))
        if r["kind"] == "link":
            out.link = max(-1.0, min(0.0, odds))
        else:
            (out.names if r["kind"] == "name" else out.tags)[r["name"]] = odds
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points of text).

    A null or empty page, or one without words outside boilerplate, gives an empty text. Repeated
    rows each give a row; an empty table gives none; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(learn_weights(pages, id_col, html_col))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), shared.value) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
