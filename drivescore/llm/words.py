"""Word-wise scoring of texts in Arrow batches, through a bounded cache of the words' values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

CACHED_WORDS = 250_000
GROUP_CHARS = 400_000
MEAN_CHARS = 24


class WordTable:
    """Values of white-space separated words: ``compute`` makes a row of floats for each new word.

    Holds at most ``limit`` words of ``MEAN_CHARS`` characters on average, or those of one group of texts;
    when more come it starts afresh.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, limit: int = CACHED_WORDS, kind: type = np.float32):
        self.compute, self.limit = compute, limit
        self.known: dict[str, int] = {}
        self.chars = 0
        self.values = np.zeros((1024, width), kind)

    def _learn(self, words: list[str]) -> None:
        n, more = len(self.known), len(words)
        while n + more > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        self.values[n : n + more] = self.compute(words)
        self.known.update(zip(words, range(n, n + more), strict=True))

    def groups(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of texts in order: the value rows of all their words, and the words in each text."""
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= GROUP_CHARS):
                chars += len(texts[stop])
                stop += 1
            lists = [t.split() for t in texts[at:stop]]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            distinct = set().union(*lists)
            fresh = distinct.difference(self.known)
            more = sum(map(len, fresh))
            if fresh and (len(self.known) + len(fresh) > self.limit or self.chars + more > self.limit * MEAN_CHARS):
                self.known.clear()
                self.chars, fresh = 0, distinct
                more = sum(map(len, fresh))
            self.chars += more
            if fresh:
                self._learn(sorted(fresh))
            rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
            yield rows, counts
            at = stop


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values``, ``counts[k]`` of them for text k; zero for none."""
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
