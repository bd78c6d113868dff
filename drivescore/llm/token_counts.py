"""Token counts of documents by unigram segmentation, over a trie of their distinct pre-tokens.

Each Arrow batch's distinct new pre-tokens enter a trie. The forward score of a trie node (best
sum of piece scores over all ways to cut the prefix that the node stands for) is computed once,
when the node is made, from the scores of the nodes above it, so pre-tokens share the work of
their common prefixes. The node where a pre-token ends stores its token count. The trie lives as
long as its task's worker and is bounded: beyond ``limit`` nodes it starts afresh.

Pieces are those of a public vocabulary file. A unigram model's scores are taken from the file. A
merge-ranked vocabulary has ranks instead of log probabilities; rank r then scores by Zipf's law,
log p = -log(r + 2.7) - log(sum over ranks), the law's usual shift.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release
from .words import WordTable, sums

MARK = "▁"
BYTE_PENALTY = 2.0
NODES = 600_000


def piece_scores(model_file: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    ids = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    scores = np.array([sp.get_score(k) for k in ids])
    if np.all(scores <= 0) and np.all(scores == np.round(scores)):
        p = -np.log(np.arange(len(ids)) + 2.7)
        order = np.argsort(-scores, kind="stable")
        ranked = np.empty(len(ids))
        ranked[order] = p - np.log(np.exp(p).sum())
        scores = ranked
    return {sp.id_to_piece(k): float(s) for k, s in zip(ids, scores, strict=True)}


class ForwardTrie:
    """Trie whose nodes keep the best forward score of their prefix and its number of tokens."""

    def __init__(self, scores: dict[str, float], limit: int = NODES):
        self.scores, self.limit = scores, limit
        self.longest = max(map(len, scores), default=1)
        self.worst = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens of the best segmentation; of equal scores the one whose last piece is longest.

        A character that no piece covers falls back to its UTF-8 bytes, a token each.
        """
        if len(self.score) > self.limit:
            self.clear()
        node, path = 0, [0]
        for i, c in enumerate(word, 1):
            below = self.children.get((node, c))
            if below is None:
                best, tokens = -np.inf, 0
                for size in range(min(self.longest, i), 0, -1):
                    s = self.scores.get(word[i - size : i])
                    if s is not None and self.score[path[i - size]] + s > best:
                        best, tokens = self.score[path[i - size]] + s, self.tokens[path[i - size]] + 1
                n = len(c.encode("utf-8", "surrogatepass"))
                if self.score[node] + n * self.worst > best:
                    best, tokens = self.score[node] + n * self.worst, self.tokens[node] + n
                below = self.children[node, c] = len(self.score)
                self.score.append(best)
                self.tokens.append(tokens)
            node = below
            path.append(node)
        return self.tokens[node]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_pretokens, n_tokens.

    Pre-tokens are the white-space separated words, each with the vocabulary's word mark before it.
    A null or empty text has none. Repeated rows each give a row; an empty table gives no rows;
    other columns are ignored. Texts are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(piece_scores(model_file))
        table = WordTable(lambda words: np.array([[trie.count(MARK + w)] for w in words], np.float64), 1, kind=np.float64)
        for b in batches:
            texts, words, tokens = [t or "" for t in b.column(1).to_pylist()], [], []
            for rows, counts in table.groups(texts):
                words.append(counts)
                tokens.append(sums(table.values[rows], counts)[:, 0])
            columns = [b.column(0), *(pa.array(np.concatenate([np.zeros(0), *x]).astype(np.int64)) for x in (words, tokens))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_pretokens", "n_tokens"])
        release(table.known, trie.children)

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(F.col(id_col), F.col(text_col).alias("__text"))).mapInArrow(run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
