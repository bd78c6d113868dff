"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Documents are tokenized in Arrow batches and cut into pieces of at most one capacity. How many
pieces there are of each length is a table of at most ``capacity`` rows, whatever the corpus: only
that histogram goes to the driver, which plans the packing on it by large-item matching. Pieces of
above one third of the capacity pair at most twice per sequence, each largest one with the largest
that still fits; smaller pieces, largest first, best-fit the remaining gaps, many equal ones at a
time. The plan is a list of runs (length, first rank, number, first sequence, offset), bounded by
the number of lengths as well. Each piece finds its run through its rank among the pieces of its
length, which comes from a two-level running count, so a length that a third of all pieces share
is not gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from string import punctuation
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import before, bounded_batches, bucket_count, staged
from .words import MEAN_CHARS

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 900_000
GROUP_WORDS = 120_000
GROUP_CHARS = 2_000_000


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, word by word through a bounded cache.

    For tokenizers of word ends whose pre-tokenizer drops white space, so that no token joins characters across a space
    or line feed (``_check`` tells others): ids of a text are the ids of its parts between those characters, one after another.
    In the same way ASCII punctuation after letters and at the end of a part is a pre-token of its
    own, and ASCII letters are put in lower case; so parts that differ in those share an entry.
    Letters that the tokenizer's normalizer turns into a letter and a mark are the exception, as the
    mark joins the punctuation: parts with those are encoded whole.

    The cache starts afresh at about ``limit`` entries, or ``MEAN_CHARS`` characters for each. Texts are read in groups of at most ``group`` words and
    ``GROUP_CHARS`` characters, or one word.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS, group: int = GROUP_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.group = Tokenizer.from_file(path), limit, group
        self.known: dict[str, bytes] = {}
        self.chars = 0
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_word = self._check()

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _check(self) -> bool:
        """Whether ids of words may be joined; a tokenizer that fails these samples is given whole texts."""
        for words in (["alpha", "Beta,", "gamma"], ["x1", "don't", '"so."'], ["a", "b"]):
            for between in (" ", "\n"):
                if self._one(between.join(words)) != b"".join(map(self._one, words)):
                    return False
        return self._one("Word,") == self._one("word") + self._one(",") and bool(self.closes.any())

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters alone: each is one pre-token, whose last id closes a word."""
        for k in range(0, len(words), 1024):
            some = words[k : k + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            if len(ends) == len(some):
                yield from map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))
            else:
                yield from map(self._one, some)

    def _learn(self, words: set[str]) -> None:
        """Bring all of the words into the cache."""
        fresh = words.difference(self.known)
        more = sum(map(len, fresh))
        if fresh and (len(self.known) + len(fresh) > self.limit or self.chars + more > self.limit * MEAN_CHARS):
            self.known.clear()
            self.chars, fresh = 0, words
            more = sum(map(len, fresh))
        self.chars += more
        known, parts, need = self.known, [], set()
        for w in sorted(fresh):
            c = w.rstrip(punctuation)
            if c.isalpha() and (c.isascii() or normalize("NFC", c).lower().isalpha()):
                tail = w[len(c) :]
                if c.isascii():
                    c = c.lower()
                parts.append((w, c, tail))
                need.add(c)
                if tail and tail not in known:
                    known[tail] = self._one(tail)
            else:
                known[w] = self._one(w) if w else b""
        letters = sorted(need.difference(known))
        known.update(zip(letters, self._letters(letters), strict=True))
        known.update([(w, known[c] + known[tail] if tail else known[c]) for w, c, tail in parts])

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; short texts are looked up together, a long one in parts."""
        if not self.by_word:
            yield from map(self._one, texts)
            return
        some, size, chars = [], 0, 0
        for t in texts:
            words = t.replace("\n", " ").split(" ")
            chars += len(t)
            if some and (size + len(words) > self.group or chars > GROUP_CHARS):
                yield from self._group(some)
                some, size, chars = [], 0, len(t)
            if len(words) > self.group:
                yield b"".join(b"".join(self._group([words[k : k + self.group]])) for k in range(0, len(words), self.group))
                continue
            some.append(words)
            size += len(words)
        yield from self._group(some)

    def _group(self, texts: list[list[str]]) -> Iterator[bytes]:
        self._learn(set().union(*texts))
        ids = self.known.__getitem__
        for words in texts:
            yield b"".join(map(ids, words))


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker: its cache serves all tasks that the worker runs, as a cold one costs each task anew."""
    return WordEncoder(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end, step = np.array([END_ID], "<u4").tobytes(), capacity * 4
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.encode(t.as_py() or "" for t in b.column(1))):
                ids += end
                for k, begin in enumerate(range(0, len(ids), step)):
                    part = ids[begin : begin + step]
                    at.append(row)
                    piece.append(k)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place all pieces.

    ``histogram`` has the number of pieces by length (1 to capacity). Rank r of a length that lies
    in a run goes to sequence ``first sequence + r - first rank`` at the run's offset.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs (first sequence, number)
    order: list[int] = []  # the gaps that exist, ascending
    top = 0

    def place(n: int, many: int, sequence: int, offset: int) -> None:
        runs.append((n, used[n], many, sequence, offset))
        used[n] += many
        left[n] -= many

    def free(gap: int, sequence: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((sequence, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect_left(large, capacity - n + 1) - 1
            while k >= 0 and (left[large[k]] < (2 if large[k] == n else 1)):
                k -= 1
            if k < 0:
                many = left[n]
                place(n, many, top, 0)
                free(capacity - n, top, many)
            else:
                m = large[k]
                many = left[n] // 2 if m == n else min(left[n], left[m])
                place(n, many, top, 0)
                place(m, many, top, n)
                free(capacity - n - m, top, many)
            top += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(order, n)
            if k < len(order):
                gap = order[k]
                sequence, there = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
                many = min(there, left[n])
                place(n, many, sequence, capacity - gap)
                free(gap - n, sequence, many)
                free(gap, sequence + many, there - many)
                continue
            each = capacity // n
            many, rest = divmod(left[n], each)
            if many:
                for k in range(each):
                    place(n, many, top, k * n)
                free(capacity - each * n, top, many)
                top += many
            if rest:
                for k in range(rest):
                    place(n, 1, top, k * n)
                free(capacity - rest * n, top, 1)
                top += 1
    return runs


def best_fit_pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 1; a null or empty text is that id alone. Only documents
    longer than the capacity are cut, at multiples of it. Each piece lies in one sequence; offsets
    in a sequence run without gaps from 0. Repeated rows are packed each. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = staged(tokenized_pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    buckets = bucket_count(pieces.count())
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    counts = staged(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "length_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = sorted(plan_packing(histogram, capacity))
    table = spark.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 5))  # bounded by the number of lengths, not of pieces

    bases = counts.withColumn("base", before(F.col("n"), ["length"], [F.col("bucket")])).select("length", "bucket", "base")
    within = W.partitionBy("length", "bucket").orderBy(F.asc_nulls_last("id"), "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(within)).join(bases, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        # Ranks are below 2**50 and lengths below 2**13, so (length, rank) has a place in one integer.
        starts = (runs[:, 0] << 50) + runs[:, 1]
        for b in batches:
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            own = np.searchsorted(starts, (b.column("length").to_numpy(zero_copy_only=False) << 50) + rank, "right") - 1
            sequence = runs[own, 3] + rank - runs[own, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(runs[own, 4])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
