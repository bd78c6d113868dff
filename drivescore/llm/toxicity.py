"""Toxicity by a linear-chain conditional random field over the words of a text.

The field has two states and tags each word as plain or toxic. A word's features are the log-odds, in a lexicon of the
sample, of its form and of its prefixes of 4 to 6 letters; the field also has a bias and transitions. Labels are given for
documents, not for words, so the words' states are hidden: each toxic word is noticed with a probability (at first ``NOTICE``),
a document has label 1 if one was, and the weights and that probability maximise the likelihood of the documents' labels (``fit_chain``). No threshold
on a word's counts names its state. Forward-backward gives each word's marginal; a document's
score is a logistic of the marginals' sum and maximum, fitted on the sample and set to the share
of toxic rows in all labelled training rows. Spans are the runs of words whose marginal is 0.5 or
more, as code point offsets.

Most words have no weight at all. Their factor is the same matrix, so the exact recursions step over
a run of k such words by that matrix' k-th power and touch only the others.

The sample holds about ``SAMPLE_ROWS`` training rows of each label, chosen by a hash of the id, one
for each minimum hash of 5-word shingles so that copies count once. Its model is bounded by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, staged
from .words import WordTable

SAMPLE_ROWS = 6000
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
LEAST_DOCS = 3
DOUBT = 1.5
NOTICE = 0.45
WIDTH = 9  # words of a window of the fit; every word with a lexicon entry of a sampled text lies in one
LEAST_ODDS = 0.5
SPAN = "array<struct<start:long,end:long,p:double>>"


def core(word: str) -> str:
    return word.lower() if word.isalnum() else "".join(c for c in word.lower() if c.isalnum())


def keys(word: str) -> list[str]:
    """The word's form and its prefixes, as lexicon keys."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


@dataclass
class Tagger:
    lexicon: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, *(0.0 for _ in PREFIXES)]))
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 3.0]))

    def __post_init__(self):
        self.powers = lru_cache(4096)(self._power)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "powers"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def word_features(self, words: list[str]) -> np.ndarray:
        """Log-odds of a word's form and of its prefixes; 0 where the lexicon has none."""
        out = np.zeros((len(words), 1 + len(PREFIXES)))
        for k, w in enumerate(words):
            if c := core(w):
                for key in keys(c):
                    if key in self.lexicon:
                        out[k, 0 if key[-1] != "*" else PREFIXES.index(len(key) - 1) + 1] = self.lexicon[key]
        return out

    def word_weights(self, words: list[str]) -> np.ndarray:
        """Weight of each word, as a column; 0 for a word without any feature."""
        get, out = self.scaled().get, np.zeros((len(words), 1), np.float32)
        for k, w in enumerate(words):
            c = core(w)
            total = get(c, 0.0)
            for n in PREFIXES:
                if len(c) > n:
                    total += get(c[:n] + "*", 0.0)
            if total:
                out[k, 0] = total
        return out

    def scaled(self) -> dict[str, float]:
        """The lexicon with each entry times its feature's weight."""
        return {key: v * self.weights[0 if key[-1] != "*" else PREFIXES.index(len(key) - 1) + 1] for key, v in self.lexicon.items()}

    def _power(self, k: int) -> np.ndarray:
        step = np.exp(self.moves) * np.array([1.0, np.exp(self.bias)])
        return np.linalg.matrix_power(step / np.abs(np.linalg.eigvals(step)).max(), k)

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's weighted words and those beside them, and each one's marginal of being toxic.

        ``x`` has the weight of each word of the text.
        """
        hit = np.flatnonzero(x)
        if not len(hit):
            return hit, np.zeros(0)
        n = len(x)
        places = np.unique(np.clip(np.concatenate((hit - 1, hit, hit + 1)), 0, n - 1))
        unary = np.column_stack([np.ones(len(places)), np.exp(np.clip(self.bias + x[places].astype(float), -50, 50))])
        step = np.exp(self.moves)
        forward, backward = np.empty((len(places), 2)), np.empty((len(places), 2))
        a = self._start(int(places[0])) * unary[0]
        forward[0] = a / a.sum()
        gaps = (np.diff(places) - 1).tolist()
        for k, gap in enumerate(gaps, 1):
            a = forward[k - 1] @ self.powers(gap) @ step * unary[k] if gap else forward[k - 1] @ step * unary[k]
            forward[k] = a / a.sum()
        b = self.powers(n - 1 - int(places[-1])) @ np.ones(2)
        backward[-1] = b / b.sum()
        for k in range(len(places) - 2, -1, -1):
            b = step @ (unary[k + 1] * backward[k + 1])
            if gaps[k]:
                b = self.powers(gaps[k]) @ b
            backward[k] = b / b.sum()
        p = forward * backward
        return places, p[:, 1] / p.sum(1)

    def _start(self, before: int) -> np.ndarray:
        """Weights of the two states that meet the first weighted place, after ``before`` plain words."""
        if not before:
            return np.ones(2)
        first = np.array([1.0, np.exp(self.bias)])
        v = first @ self.powers(before - 1) @ np.exp(self.moves)
        return v / v.sum()

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = self.calibration[0] + self.calibration[1] * np.log1p(total) + self.calibration[2] * most
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chain_sums(unary: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log Z, marginals p[w, t], expected numbers of the four moves) of windows of equal length."""
    n, length = unary.shape
    fw, bw, log_z = np.empty((n, length, 2)), np.ones((n, length, 2)), np.zeros(n)
    for t in range(length):
        a = fw[:, t - 1] @ step if t else np.ones((n, 2))
        a[:, 1] *= unary[:, t]
        z = a.sum(1)
        fw[:, t], log_z = a / z[:, None], log_z + np.log(z)
    moves = np.zeros((n, 4))
    for t in range(length - 1, 0, -1):
        b = bw[:, t].copy()
        b[:, 1] *= unary[:, t]
        pair = (fw[:, t - 1, :, None] * step * b[:, None, :]).reshape(n, 4)
        moves += pair / pair.sum(1, keepdims=True)
        b = b @ step.T
        bw[:, t - 1] = b / b.sum(1, keepdims=True)
    p = fw * bw
    return log_z, p[:, :, 1] / p.sum(2), moves


def fit_chain(
    x: np.ndarray, doc: np.ndarray, toxic: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3, times: np.ndarray | None = None, fit_notice: bool = True
) -> tuple[np.ndarray, float, np.ndarray, float]:
    """Weights, bias, transitions and chance of notice of largest likelihood of the documents' labels, with the words' states hidden.

    ``x[w, t]`` are the features of word t of window w, which its document has ``times[w]`` times (1 if None); ``doc[w]`` is the
    window's document, ``toxic[d]`` its label. A toxic word is noticed with probability v; label 1 means that one was. The
    probability of label 0 is then R = Z' / Z, where Z' has the factors of toxic words times 1 - v. The gradient of log R is
    E'[f] - E[f], that of log(1 - R) is R / (1 - R) (E[f] - E'[f]); by the logit of v they are -v E'[toxic words] and
    R / (1 - R) v E'[toxic words]. Windows that are alike, in whatever document, are walked once a round.
    """
    n, size = len(toxic), x.shape[2]
    different, which = np.unique(x.reshape(len(x), -1), axis=0, return_inverse=True)
    x, which = different.reshape(-1, *x.shape[1:]), which.ravel()
    times = np.ones(len(which)) if times is None else times
    theta = prior = np.concatenate(([1.0], np.zeros(size - 1), [-4.0], np.zeros(4), [np.log(NOTICE / (1 - NOTICE))]))
    # Transitions and the chance of notice stay near their start where texts don't tell.
    decays = np.repeat((decay, 50 * decay), (size + 1, 5))
    m = v = np.zeros(len(theta))
    for k in range(1, rounds + 1):
        step, notice = np.exp(theta[-5:-1].reshape(2, 2)), 1 / (1 + np.exp(-theta[-1]))
        unary = np.exp(np.clip(theta[-6] + x @ theta[:size], -50, 50))
        log_z, p, moves = chain_sums(unary, step)
        log_u, q, missed = chain_sums(unary * (1 - notice), step)
        log_r = np.minimum(np.bincount(doc, times * (log_u - log_z)[which], n), -1e-9)
        pull = np.bincount(which, times * np.where(toxic, np.exp(log_r) / -np.expm1(log_r), -1.0)[doc], len(x))
        more = pull[:, None] * (p - q)
        noticed = notice * (pull @ q.sum(1)) if fit_notice else 0.0
        g = np.concatenate((np.einsum("wt,wtf->f", more, x), [more.sum()], pull @ (moves - missed), [noticed])) / n - decays * (theta - prior)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:size], float(theta[-6]), theta[-5:-1].reshape(2, 2), float(1 / (1 + np.exp(-theta[-1])))


def cover(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different windows of WIDTH words, how often each occurs) that together hold every word with a positive feature once.

    A window begins half its width before the first such word that no window holds yet, or where the last one ends; the
    text's end is filled up with words without features.
    """
    hits = np.flatnonzero(f.max(1) > 0).tolist()
    starts: list[int] = []
    end = 0
    for h in hits:
        if not starts or h >= end:
            starts.append(max(end, h - WIDTH // 2))
            end = starts[-1] + WIDTH
    f = np.concatenate((f, np.zeros((WIDTH, f.shape[1]))))
    rows = f[np.array(starts, int)[:, None] + np.arange(WIDTH)].reshape(len(starts), WIDTH * f.shape[1])
    return np.unique(rows.astype(np.float32), axis=0, return_counts=True)


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, kind, text) of the sample, one row for each label and kind, and the numbers of all labelled training rows by label."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    u = F.shiftrightunsigned(F.xxhash64("l_id", F.lit("toxic sample")), 11) / F.lit(float(1 << 53))
    most = F.when(F.col("label") == 1, rows / max(1, counts.get(1, 0))).otherwise(rows / max(1, counts.get(0, 0)))
    chosen = F.broadcast(known.filter(u < most))  # about 2 * rows ids: bounded by the parameter
    sample = bounded_batches(docs).filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.col("id") == F.col("l_id"))

    def kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            low = []
            for t in b.column("text"):
                w = t.as_py().lower().split()
                low.append(min(xxh64_intdigest(" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))) >> 1)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("text"), pa.array(low, pa.int64())], names=["label", "text", "kind"])

    rows = sample.select("label", "text").mapInArrow(kind, "label int, text string, kind long")
    # Of equal kinds the text of least hash, so that the model is the same in every run.
    return rows.groupBy("label", "kind").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), counts


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Tagger:
    spark = docs.sparkSession
    sample, counts = training_rows(docs, labels, id_col, text_col, label_col, rows)
    sample = staged(sample, "toxic_sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for key in {k for w in set(map(core, set(text.as_py().split()))) if w for k in keys(w)}:
                    seen.setdefault(key, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c[1] for c in seen.values()], pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64())], names=["key", "bad", "good"])

    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    tagger = Tagger({})
    if not bad or not good:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        tagger.calibration = np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0])
        return tagger
    # The lexicon has the log-odds of forms and prefixes that toxic documents favour beyond doubt, as far as that bound, and of
    # words with such a prefix that clean ones favour.
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    doubt = DOUBT * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    counted = sample.select("label", "text").mapInArrow(tally, "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = staged(counted.filter(F.greatest("bad", "good") >= LEAST_DOCS).select("key", "bad", odds.alias("odds"), doubt.alias("doubt")), "toxic_words")
    found = counted.filter((F.col("bad") >= LEAST_DOCS) & (F.col("odds") - F.col("doubt") > LEAST_ODDS))
    tagger.lexicon = {r["key"]: r["odds"] - r["doubt"] for r in found.collect()}  # bounded by the sample
    stems = F.broadcast(found.filter(F.col("key").endswith("*")).select(F.col("key").alias("stem")))
    forms = counted.filter((F.col("odds") + F.col("doubt") < 0) & ~F.col("key").endswith("*"))
    forms = forms.withColumn("stem", F.explode(F.array(*[F.concat(F.substring("key", 1, n), F.lit("*")) for n in PREFIXES])))
    tagger.lexicon |= {r["key"]: r["odds"] + r["doubt"] for r in forms.join(stems, "stem", "left_semi").select("key", "odds", "doubt").distinct().collect()}
    shared = spark.sparkContext.broadcast(tagger)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            docs, xs, ns = [], [], []
            for at, text in enumerate(b.column(1)):
                rows, times = cover(t.word_features(text.as_py().split()))
                docs += [at] * len(rows)
                xs += list(rows)
                ns += times.tolist()
            at = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(xs, pa.list_(pa.float32())), pa.array(ns, pa.int64())], names=["label", "kind", "x", "n"])

    # Different windows of the sampled texts: words of the lexicon and what stands beside them, not all words.
    got = sample.select("label", "text", "kind").mapInArrow(windows, "label int, kind long, x array<float>, n long").toArrow()
    if got.num_rows:
        label, kind, times = (got.column(k).to_numpy() for k in (0, 1, 3))
        x = got.column(2).combine_chunks().flatten().to_numpy().reshape(len(label), WIDTH, -1).astype(float)
        order = np.lexsort((*x.reshape(len(x), -1).T[::-1], kind, label))  # the fit does not depend on the order of tasks
        docs_of, doc = np.unique(np.column_stack((label, kind))[order], axis=0, return_inverse=True)
        tagger.weights, tagger.bias, tagger.moves, _ = fit_chain(x[order], doc.ravel(), docs_of[:, 0] == 1, times=times[order].astype(float))

    shared_tagger = spark.sparkContext.broadcast(tagger)
    seen = summaries(sample.select(F.col("label").alias("id"), "text"), shared_tagger).toArrow()  # a row for each sampled row
    z = np.column_stack([np.ones(seen.num_rows), np.log1p(seen.column(1).to_numpy()), seen.column(2).to_numpy()])
    label = seen.column(0).to_numpy().astype(float)
    order = np.lexsort((z[:, 1], z[:, 2], label))
    z, label = z[order], label[order]
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (label - p) - 0.1 * beta
        beta = beta + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3), gradient)
    # The sample holds as many rows of either label; all training rows do not.
    beta[0] += np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - np.log(bad / good)
    tagger.calibration = beta
    return tagger


def spans_of(text: str, places: np.ndarray, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of words whose marginal is ``least`` or more: code point offsets, and the run's largest marginal."""
    spans: list[dict] = []
    toxic = {int(a): float(q) for a, q in zip(places, p, strict=True) if q >= least}
    if toxic:
        last = -2
        for at, m in enumerate(re.finditer(r"\S+", text)):
            if at in toxic:
                if at == last + 1:
                    spans[-1] |= {"end": m.end(), "p": max(spans[-1]["p"], toxic[at])}
                else:
                    spans.append({"start": m.start(), "end": m.end(), "p": toxic[at]})
                last = at
    return spans


def batch_summaries(t: Tagger, table: WordTable, texts: list[str | None]) -> Iterator[tuple[float, float, list[dict]]]:
    """(sum, maximum, spans) of the marginals of each text; texts without any weighted word are not walked."""
    at = 0
    for rows, counts in table.groups([x or "" for x in texts]):
        x = table.values[rows, 0]
        stops = np.cumsum(counts)
        hits = np.concatenate(([0], np.cumsum(x != 0)))
        some = hits[stops] > hits[stops - counts]
        for stop, n, any_hit in zip(stops.tolist(), counts.tolist(), some.tolist(), strict=True):
            if any_hit:
                places, p = t.marginals(x[stop - n : stop])
                yield float(p.sum()), float(p.max()), spans_of(texts[at] or "", places, p)
            else:
                yield 0.0, 0.0, []
            at += 1


def summaries(docs: DataFrame, shared) -> DataFrame:
    """(id, total, most, spans) of (id, text) rows: sum and maximum of the marginals, and toxic spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        table = WordTable(t.word_weights, 1)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for b in batches:
            out = list(batch_summaries(t, table, b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], kind)], names=["id", "total", "most", "spans"])
        release(table.known)

    kind = docs.schema["id"].dataType.simpleString()
    return bounded_batches(docs.select("id", "text")).mapInArrow(run, f"id {kind}, total double, most double, spans {SPAN}")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, spans (array of start, end, p).

    Learns from labelled rows outside the held-out fold (crc32 of the id as text, mod 4, is 2); a
    null label or id is not learned from, a null id is not held out. Null, empty and unknown texts
    score the share of toxic rows that the fit leaves for texts without any weighted word, and have no span. Without both
    labels to learn from, every score is the share of label 1 (near 0 if there is no label). Repeated
    rows each give a row; an empty table gives none; other columns are ignored.
    """
    return score_with(docs, train(docs, labels, id_col, text_col, label_col, rows), id_col, text_col)


def score_with(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted and spans of every row of ``docs`` by a trained tagger; null and empty texts score as those without spans.

    Repeated rows each give a row, an empty table none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    a, b, c = (float(x) for x in tagger.calibration)
    z = F.lit(a) + F.lit(b) * F.log1p("total") + F.lit(c) * F.col("most")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    scored = summaries(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shared)
    return scored.withColumn("score", score).select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; each row stays where it is.

    A null or empty text is kept unless the share of toxic rows is above the threshold; repeated rows are judged each and
    alike; an empty table gives no rows. Labels as in ``toxicity``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        table = WordTable(t.word_weights, 1)
        for b in batches:
            found = np.array([x[:2] for x in batch_summaries(t, table, b.column(at).to_pylist())]).reshape(-1, 2)
            yield b.filter(pa.array(t.score(found[:, 0], found[:, 1]) < THRESHOLD))
        release(table.known)

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.withColumn("spans", shown)
