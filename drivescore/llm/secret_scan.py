"""Secret scans through a trigram inverted index. DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams of the lower-case text is derived:
a disjunction of sets of trigrams, one of which every match must hold completely. The trigrams of
all rules are the index's vocabulary. One pass over the texts finds which of them a text holds, and ``build_index`` writes a posting (trigram,
row) for each, in one folder for each trigram. A set's postings are intersected by counting for each row the set's
trigrams it has; rows that satisfy a set of a rule are that rule's candidates, and only they are verified with
the expression, in a second pass. A rule without mandatory trigrams (a hexadecimal run) scans all, in the first pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, staged

ANY = [frozenset()]
MOST_STRINGS, MOST_SETS = 64, 64
KEY = ["key", "key2"]
CANDIDATES = 500_000


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` or more characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


# Fixed patterns. A run of 16 or 32 and more is the same as the run of any length that is dropped if shorter.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


def _least(sets: list[frozenset]) -> list[frozenset]:
    """The sets without those that contain another one; any text passes if there are too many."""
    out: list[frozenset] = []
    for s in sorted(set(sets), key=lambda s: (len(s), sorted(s))):
        if not any(o <= s for o in out):
            out.append(s)
    return out if len(out) <= MOST_SETS else ANY


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    return _least([x | y for x in a for y in b])


def _of_strings(strings: set[str]) -> list[frozenset]:
    return _least([frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings])


def _derive(items) -> tuple[set[str] | None, list[frozenset]]:
    """The strings that the expression matches, if they are few; and its trigram query."""
    strings: set[str] = {""}
    query, whole = ANY, True
    for op, arg in items:
        exact, inner = None, ANY
        if op is sre.LITERAL:
            exact = {chr(arg).lower()}
        elif op is sre.IN:
            found: set[str] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL and found is not None:
                    found.add(chr(value).lower())
                elif kind is sre.RANGE and found is not None and value[1] - value[0] < 8:
                    found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    found = None
            exact = found if found and len(found) <= 8 else None
        elif op is sre.SUBPATTERN:
            exact, inner = _derive(arg[-1])
        elif op is sre.BRANCH:
            parts = [_derive(x) for x in arg[1]]
            exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            inner = _least([s for p in parts for s in p[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            some, inner = _derive(body)
            if some is not None and high == 1:
                exact = some | ({""} if low == 0 else set())
            elif some is not None and low == high and low <= 4:
                exact = {""}
                for _ in range(low):
                    exact = {a + b for a in exact for b in some}
            if low == 0:
                inner = ANY
        elif op is sre.AT:
            exact = {""}
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in exact}
            continue
        query = _both(_both(query, _of_strings(strings)), inner if exact is None else _of_strings(exact))
        strings, whole = {""}, False
    return (strings if whole else None), _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> list[frozenset]:
    """Sets of lower-case trigrams; every match of ``pattern`` holds all of at least one set."""
    return _derive(parser.parse(pattern))[1]


def vocabulary(rules=RULES) -> list[str]:
    return sorted({t for r in rules for s in trigram_query(r.pattern) for t in s})


def build_index(entries: DataFrame) -> DataFrame:
    """Posting lists (word, key) of ``entries``, whose ``held`` are the places of a text's trigrams in the vocabulary; written, a folder a trigram.

    Lists are dealt over tasks by their length before they are written, so that a folder has few files and a long list several.
    """
    postings = entries.select(*KEY, F.explode("held").alias("word")).distinct()
    return staged(postings.hint("rebalance", "word"), "postings", ["word"])


def candidates(index: DataFrame, rules: tuple[Rule, ...], words: list[str]) -> DataFrame:
    """(key, rules): for each row the rules of which it satisfies a set of trigrams, as a bitmap.

    Each set's posting lists are intersected: a row is in all of them if it has as many postings as the set has trigrams.
    """
    at = {w: k for k, w in enumerate(words)}
    queries = [(k, s) for k, r in enumerate(rules) for s in trigram_query(r.pattern) if s]
    wanted = [(at[t], n, k, len(s)) for n, (k, s) in enumerate(queries) for t in sorted(s)]
    sets = index.sparkSession.createDataFrame(wanted, "word int, set int, rule int, need int")  # as many rows as the rules have trigrams
    lists = index.join(F.broadcast(sets), "word")
    both = lists.groupBy(*KEY, "set", "rule", "need").agg(F.count("*").alias("n")).filter("n = need")
    return both.groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind, end) of the rule's matches, leftmost first, in code points.

    One pass of the expression puts marks around each match and its group; all lengths follow from the marks. Marks in the text
    itself are first replaced by another control character, which no rule matches either.
    """
    plain = F.translate(text, "\x01\x02\x03", "\x04\x04\x04")
    marked = F.regexp_replace(plain, F.lit(rule.java), F.lit(f"\x01$0\x02{f'${rule.group}' if rule.group else ''}\x03"))
    parts = F.split(marked, "\x01", -1)

    def sizes(part: Column) -> Column:
        own, rest = F.length(F.substring_index(part, "\x02", 1)), F.substring_index(part, "\x02", -1)
        held = F.length(F.substring_index(rest, "\x03", 1)) if rule.group else own
        return F.struct(own.alias("own"), held.alias("held"), F.length(F.substring_index(rest, "\x03", -1)).alias("gap"))

    def step(acc, x):
        end = acc["at"] + x["own"]
        span = F.struct(acc["at"].alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct((end + x["gap"]).alias("at"), F.when(x["held"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    matches = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), sizes)
    return F.aggregate(matches, F.struct(F.length(parts[0]).alias("at"), NOTHING().alias("spans")), step, lambda acc: acc["spans"])


def NOTHING() -> Column:
    return F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")


def secret_scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty. Matches of a kind are leftmost and do not overlap, and those with too
    few characters are dropped. Spans are kind:start:end in code points, end exclusive, by start and
    then kind as listed, joined by commas; ``base_sha256`` is of the base kinds' spans alone. Repeated
    rows each give a row; an empty table gives none; other columns are ignored.
    """
    words = vocabulary(rules)
    indexed = [k for k, r in enumerate(rules) if all(trigram_query(r.pattern))]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # 128 bits of hash name a row; rows repeated with id and text share a name, and so their spans.
    rows = rows.select("id", "t", F.xxhash64("id", "t").alias("key"), F.xxhash64("t", F.lit("second"), "id").alias("key2"))
    scanned = [F.when(F.col("t").rlike(r.java), rule_spans(F.col("t"), r, k)).otherwise(NOTHING()) for k, r in enumerate(rules) if k not in indexed]
    # One pass reads the texts for the trigrams that they hold and for the rules that scan all. Each step is a projection of its own, so that a
    # text is put in lower case once and not for each trigram.
    low = rows.select("id", *KEY, (F.concat(*scanned) if scanned else NOTHING()).alias("scanned"), F.lower("t").alias("low"))
    flags = low.select("id", *KEY, "scanned", F.array(*[F.contains("low", F.lit(w)) for w in words]).alias("flags"))
    held = F.array_compact(F.transform("flags", lambda x, k: F.when(x, k)))
    entries = staged(flags.select("id", *KEY, "scanned", held.alias("held")), "entries")
    named = staged(candidates(build_index(entries), rules, words), "candidates")
    verified = [F.when(F.col("rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0, rule_spans(F.col("t"), rules[k], k)).otherwise(NOTHING()) for k in indexed]
    # The second pass asks for candidates' texts alone. Their names go to the texts where they are few enough, else names and texts meet by key.
    found = narrow(named, CANDIDATES).join(rows.select(*KEY, "t"), KEY).select(*KEY, F.concat(NOTHING(), *verified).alias("verified")).filter(F.size("verified") > 0)
    found = found.dropDuplicates(KEY)
    scans = entries.select("id", *KEY, "scanned")
    spans = scans.join(found, KEY, "left").select("id", F.array_sort(F.concat("scanned", F.coalesce("verified", NOTHING()))).alias("s"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [k for k, r in enumerate(rules) if r.base]

    def shown(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")

    def number(k: int) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{rules[k].kind}")

    counts = [number(k) for k in base]
    return spans.select(F.col("id").alias(id_col), *counts, F.sha2(shown(F.filter("s", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"))


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    columns, parts = [], []
    for k, r in enumerate(RULES):
        p = quoted(r.java)
        columns.append(f"regexp_extract_all(t, {p}, 0) as f{k}, regexp_extract_all(t, {p}, {r.group}) as g{k}, regexp_split_to_array(t, {p}) as b{k}")
        begin = f"cast(list_sum(list_transform(b{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f{k}[1:i - 1], lambda x: length(x))), 0) as bigint)"
        parts.append(f"list_transform(list_filter(range(1, len(f{k}) + 1), lambda i: length(g{k}[i]) >= {r.least}), lambda i: {{'start': {begin}, 'kind': {k}, 'n': length(f{k}[i])}})")
    names = "[" + ", ".join(quoted(r.kind) for r in RULES) + "]"
    show = f"lambda x: {names}[x.kind + 1] || ':' || x.start || ':' || (x.start + x.n)"
    return f"""
with m as (select doc_id, {', '.join(columns)} from (select doc_id, coalesce(text, '') as t from documents)),
s as (select doc_id, list_sort(list_concat({', '.join(parts)})) as s from m)
select doc_id, cast(len(list_filter(s, lambda x: x.kind = 0)) as bigint) as n_assign, cast(len(list_filter(s, lambda x: x.kind = 1)) as bigint) as n_access,
  cast(len(list_filter(s, lambda x: x.kind = 2)) as bigint) as n_hex,
  sha256(coalesce(array_to_string(list_transform(list_filter(s, lambda x: x.kind < 3), {show}), ','), '')) as base_sha256,
  coalesce(array_to_string(list_transform(s, {show}), ','), '') as spans
from s
"""


ORACLE_SQL = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
