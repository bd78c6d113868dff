"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order ``ORDER`` over lower-case words (a word's letters
between two boundary signs). N-grams are counted on Spark over a sample of the labelled rows: for
each language the expected ``SAMPLE_DOCS`` documents of smallest hash, whole texts. The models are
kept in back-off form in sorted arrays of 64-bit n-gram hashes, shared by all languages, with a row
of log probabilities and of back-off weights for each n-gram; both are bounded by the sample. A
document gets the language of lowest cross-entropy per character; the score is the posterior of
a softmax over the negative cross-entropies, and
``rejected`` is true where the cross-entropy lies above what nearly all documents of that
language show. Temperature and limits are fitted on a fifth of the sample, by a model of the other four fifths. Words are
letters and combining marks of them are left out, as case is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, staged
from .words import WordTable, sums

ORDER = 5
SAMPLE_DOCS = 300
FOLDS, HELD = 5, 0
REJECT_QUANTILE = 0.999
EDGE = "\x00"
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(c for c in word.lower() if c.isalpha())


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` codes that end at each place (garbage for the first ones)."""
    h = np.full(len(codes), np.uint64(size), np.uint64)
    for k in range(size - 1, -1, -1):
        shifted = np.concatenate((np.zeros(min(k, len(codes)), np.uint64), codes[: max(0, len(codes) - k)]))
        h = (h ^ (shifted + np.uint64(1))) * MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """For each order: sorted hashes, log probabilities and back-off weights by language."""

    languages: list[str]
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    reject_above: np.ndarray | None = None

    def score_words(self, words: list[str]) -> np.ndarray:
        """For each word: negative log likelihood by language, then the number of its characters."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        cores = [letters(w) for w in words]
        sizes = np.fromiter(map(len, cores), np.int64, len(cores))
        live = np.flatnonzero(sizes)
        if not len(live):
            return out
        joined = EDGE + EDGE.join(cores[k] for k in live) + EDGE
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        own = sizes[live] + 1  # every word predicts its letters and the sign after them
        places = np.arange(1, len(codes))
        starts = np.concatenate(([0], np.cumsum(own)[:-1]))
        depth = places - np.repeat(starts, own)  # characters of context in the word, with its first sign
        total = np.zeros((len(places), len(self.languages)))
        todo = np.arange(len(places))
        grams = {n: gram_hashes(codes, n) for n in range(1, len(self.hashes) + 1)}
        for n in range(len(self.hashes), 0, -1):
            here = todo[depth[todo] >= n - 1]
            at = np.searchsorted(self.hashes[n - 1], grams[n][places[here]])
            at[at == len(self.hashes[n - 1])] = 0
            hit = self.hashes[n - 1][at] == grams[n][places[here]]
            total[here[hit]] += self.logp[n - 1][at[hit]]
            miss = here[~hit]
            if n > 1 and len(miss):
                context = grams[n - 1][places[miss] - 1]
                at = np.searchsorted(self.hashes[n - 2], context)
                at[at == len(self.hashes[n - 2])] = 0
                known = self.hashes[n - 2][at] == context
                total[miss[known]] += self.backoff[n - 2][at[known]]
            elif n == 1:
                total[miss] += self.floor
            done = np.zeros(len(places), bool)
            done[here[hit]] = True
            todo = todo[~done[todo]]
        out[live, :-1] = -np.add.reduceat(total, starts, 0)
        out[live, -1] = own
        return out


def kneser_ney(counts: dict[str, dict[str, int]], languages: list[str], order: int = ORDER) -> Model:
    """Model from n-gram counts by language (n-grams of all orders, as strings with EDGE signs).

    Orders below the highest use continuation counts, except n-grams that begin at a word's start.
    """
    tables = []
    for lang in languages:
        raw = counts[lang]
        count: list[dict[str, float]] = [{} for _ in range(order + 1)]
        for g, c in raw.items():
            if len(g) == order or len(g) > 1 and g[0] == EDGE:
                count[len(g)][g] = c
        for g in raw:
            if len(g) > 1:
                count[len(g) - 1][g[1:]] = count[len(g) - 1].get(g[1:], 0) + 1
        tables.append(count)
    alphabet = len(set().union(*(t[1] for t in tables))) + 1
    floor = np.full(len(languages), -np.log(alphabet))
    probs: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
    backs: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
    union = [set().union(*(t[n] for t in tables)) for n in range(order + 1)]
    for n in range(1, order + 1):
        contexts: dict[str, np.ndarray] = {}
        discount = np.zeros(len(languages))
        for k, t in enumerate(tables):
            ones, twos = sum(c == 1 for c in t[n].values()), sum(c == 2 for c in t[n].values())
            discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
            for g, c in t[n].items():
                x = contexts.setdefault(g[:-1], np.zeros((2, len(languages))))
                x[0, k] += c
                x[1, k] += 1
        lower_of = probs[n - 1]
        for h, (mass, kinds) in contexts.items():
            backs[n - 1][h] = np.log(np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0))
        for g in union[n]:
            mass, _ = contexts[g[:-1]]
            c = np.array([t[n].get(g, 0) for t in tables], float)
            seen = np.where(mass > 0, np.maximum(c - discount, 0) / np.maximum(mass, 1), 0.0)
            if n == 1:
                lower = np.exp(floor)
            else:
                lower = np.exp(_lookup(g[1:], probs, backs, floor))
            probs[n][g] = np.log(seen + np.exp(backs[n - 1][g[:-1]]) * lower)
    hashes, logp, backoff = [], [], []
    for n in range(1, order + 1):
        grams = sorted(set(probs[n]) | set(backs[n]))
        size = np.array([n] * len(grams))
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = gram_hashes(codes, n)[np.cumsum(size) - 1] if len(grams) else np.zeros(0, np.uint64)
        p = np.array([_lookup(g, probs, backs, floor) if g not in probs[n] else probs[n][g] for g in grams]).reshape(-1, len(languages))
        b = np.array([backs[n].get(g, np.zeros(len(languages))) for g in grams]).reshape(-1, len(languages))
        by = np.argsort(h)
        hashes.append(h[by] if len(h) else np.zeros(1, np.uint64))
        logp.append(p[by] if len(h) else np.zeros((1, len(languages))))
        backoff.append(b[by] if len(h) else np.zeros((1, len(languages))))
    start = backs[0].get("", np.zeros(len(languages)))
    return Model(languages, hashes, logp, backoff, floor + start)


def _lookup(gram: str, probs: list, backs: list, floor: np.ndarray) -> np.ndarray:
    """Log probability of a gram's last character after the others, by language."""
    total = 0.0
    while gram:
        if gram in probs[len(gram)]:
            return total + probs[len(gram)][gram]
        total = total + backs[len(gram) - 1].get(gram[:-1], 0.0)
        gram = gram[1:]
    return total + floor


def word_grams(word: str, order: int = ORDER) -> Iterator[str]:
    core = EDGE + letters(word) + EDGE
    for end in range(2, len(core) + 1):
        for n in range(1, min(order, end) + 1):
            yield core[end - n : end]


def held_out(id_col: str, folds: int = FOLDS, held: int = HELD):
    """Whether crc32 of the id as text leaves ``held``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of about ``per_language`` documents of each language, by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11) / F.lit(float(1 << 53))
    # The sample's ids alone meet the sizes, so that no text is dealt by language.
    chosen = rows.select("id", "lang").join(sizes, "lang").filter(u * F.col("n") < per_language).select(F.col("id").alias("c_id")).distinct()
    # About ``per_language`` ids of each language: bounded by the parameter.
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("c_id"), "left_semi").select("lang", "text")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS, order: int = ORDER) -> Model | None:
    """Model from the labelled rows outside the held-out fold; None if there are none."""
    sample = labelled_sample(docs, id_col, text_col, lang_col, per_language)
    # A fifth of the sample, by the text's hash, is held back for the calibration.
    sample = staged(sample.withColumn("back", F.pmod(F.xxhash64("text"), F.lit(5)) == 0), "lid_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams: Counter = Counter()
            words: Counter = Counter()
            for lang, text, back in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words.update((lang, back, w) for w in text.as_py().split())
            for (lang, back, w), c in words.items():
                if letters(w):
                    for g in word_grams(w, order):
                        grams[lang, back, g] += c
            keys = list(grams)
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], kind) for j, kind in enumerate((pa.string(), pa.bool_(), pa.string()))] + [pa.array(list(grams.values()), pa.int64())], names=["lang", "back", "gram", "c"])

    tallied = bounded_batches(sample).mapInArrow(count, "lang string, back boolean, gram string, c long")
    got = tallied.groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.sum(F.when(~F.col("back"), F.col("c")).otherwise(0)).alias("fit")).toArrow()  # bounded by the sample
    counts: dict[str, dict[str, int]] = {}
    fit: dict[str, dict[str, int]] = {}
    for lang, g, c, f in zip(*(got.column(k).to_pylist() for k in range(4)), strict=True):
        counts.setdefault(lang, {})[g] = c
        if f:
            fit.setdefault(lang, {})[g] = f
    if not counts:
        return None
    model = kneser_ney(counts, sorted(counts), order)
    model.reject_above = np.full(len(model.languages), np.inf)
    if fit:
        calibrate(model, sample.filter("back").select(F.col("lang").alias("id"), "text"), kneser_ney(fit, sorted(fit), order))
    return model


def calibrate(model: Model, held: DataFrame, part: Model) -> None:
    """Fit the temperature and the limits of rejection on texts (id: language) that the model ``part`` has not seen.

    A language without such texts rejects none.
    """
    scored = entropies(held, part).filter(F.col("n") > 0).filter(F.col("id").isin(part.languages)).toArrow()  # a row for each held back text
    if not scored.num_rows:
        return
    truth = np.array([part.languages.index(x) for x in scored.column("id").to_pylist()], int)
    x = np.array(scored.column("nll").to_pylist(), float).reshape(len(truth), -1) / np.array(scored.column("n").to_pylist(), float)[:, None]
    fits = []
    for t in np.geomspace(0.5, 64, 29):
        z = -t * x
        z = z - z.max(1, keepdims=True)
        fits.append((-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(1))).mean(), t))
    model.temperature = float(min(fits)[1])
    for k, lang in enumerate(part.languages):
        if (truth == k).any():
            model.reject_above[model.languages.index(lang)] = np.quantile(x[truth == k, k], REJECT_QUANTILE)


def entropies(docs: DataFrame, model: Model) -> DataFrame:
    """(id, nll array by language, n characters) of (id, text) rows."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = WordTable(m.score_words, len(m.languages) + 1)
        for b in batches:
            got = [sums(table.values[rows], counts) for rows, counts in table.groups([t or "" for t in b.column(1).to_pylist()])]
            x = np.concatenate([np.zeros((0, len(m.languages) + 1)), *got])
            nll = pa.FixedSizeListArray.from_arrays(pa.array(x[:, :-1].ravel()), len(m.languages)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), nll, pa.array(np.rint(x[:, -1]).astype(np.int64))], names=["id", "nll", "n"])
        release(table.known)

    kind = docs.schema["id"].dataType.simpleString()
    return bounded_batches(docs.select("id", "text")).mapInArrow(run, f"id {kind}, nll array<double>, n long")


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, rejected.

    A null text or one without letters has language ``und`` and score 0, as has every text if there
    is no model. Ties go to the language first by code point. Texts are read whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    names = F.array(*[F.lit(x) for x in model.languages])
    limits = F.array(*[F.lit(float(x)) for x in model.reject_above])
    scored = entropies(rows, model).withColumn("x", F.transform("nll", lambda v: F.try_divide(v, F.col("n"))))
    scored = scored.withColumn("low", F.array_min("x")).withColumn("best", F.array_position("x", F.col("low")).cast("int"))
    weight = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(F.lit(-model.temperature) * (v - F.col("low"))))
    some = F.col("n") > 0
    return scored.select(
        F.col("id").alias(id_col),
        F.when(some, F.element_at(names, F.col("best"))).otherwise("und").alias("lang_pred"),
        F.when(some, 1 / weight).otherwise(0.0).alias("score"),
        F.when(some, F.col("low") > F.element_at(limits, F.col("best"))).otherwise(True).alias("rejected"),
    )


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, rejected.

    Learns from text and non-null language of rows outside the held-out fold (crc32 of the id as
    text, mod 5, is 0). Rows with a null id are not held out and not learned from. Repeated rows
    each give a row; an empty table gives none; other columns are ignored.
    """
    found = identify(docs, train(docs, id_col, text_col, lang_col, per_language), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
