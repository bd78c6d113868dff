"""Ensembles in memory: compiled forests that score blocks of rows, and exact Shapley values along the paths of trees.

A node table has a row for each node: feature (-1 in leaves), threshold, left, right, value, cover. Rows go left where the value is below the
threshold, or missing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import comb

import numpy as np

ROWS = 16_384
#: So many questions have one bit each in a number of two bytes.
PACKED = 15
LISTED = 6


@dataclass
class Forest:
    """Trees of one ensemble. Trees that ask the same questions are one, with the sum of their leaves, since their values add up.

    ``cuts`` holds the distinct thresholds of each feature; a node asks whether a value's place among them is above ``cut``.
    Nodes of all trees stand in a row: ``starts`` has each tree's first, ``left`` and ``right`` are places in its tree.
    """

    base: float
    cuts: list[np.ndarray]
    starts: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, trees: Iterable[np.ndarray], base: float, n_features: int) -> Forest:
        shapes: dict[bytes, int] = {}
        kept: list[np.ndarray] = []
        for t in trees:
            name = t[:, :4].tobytes()
            if name in shapes:
                kept[shapes[name]][:, 4] += t[:, 4]
            else:
                shapes[name] = len(kept)
                kept.append(t.copy())
        nodes = np.concatenate(kept) if kept else np.empty((0, 6))
        feature = nodes[:, 0].astype(np.int32)
        cuts = [np.unique(nodes[feature == f, 1]) for f in range(n_features)]
        cut = np.zeros(len(nodes), np.int32)
        for f, c in enumerate(cuts):
            cut[feature == f] = np.searchsorted(c, nodes[feature == f, 1])
        starts = np.cumsum([0, *map(len, kept)])
        return cls(base, cuts, starts, feature, cut, nodes[:, 2].astype(np.int32), nodes[:, 3].astype(np.int32), nodes[:, 4])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The sum of all trees' values and the base for each row, by blocks of rows: a node is one comparison of a block's places."""
        out = np.full(len(x), self.base)
        for begin in range(0, len(x), ROWS):
            part = x[begin : begin + ROWS]
            places = np.zeros((len(self.cuts), len(part)), np.int32)
            for f, c in enumerate(self.cuts):
                if len(c):
                    places[f] = np.where(np.isnan(part[:, f]), 0, np.searchsorted(c, part[:, f], "right"))
            total = out[begin : begin + ROWS]
            for first, end in zip(self.starts[:-1], self.starts[1:], strict=True):
                total += self.value[first:end][self._leaves(places, int(first))]
        return out

    def _leaves(self, places: np.ndarray, first: int) -> np.ndarray:
        leaf = np.zeros(places.shape[1], np.int32)
        stack: list[tuple[int, np.ndarray | None]] = [(0, None)]
        while stack:
            node, here = stack.pop()
            f = self.feature[first + node]
            if f < 0:
                if here is not None:
                    np.putmask(leaf, here, node)
                continue
            right = places[f] > self.cut[first + node]
            left = ~right
            if here is not None:
                right &= here
                left &= here
            stack += [(int(self.left[first + node]), left), (int(self.right[first + node]), right)]
        return leaf


def tree_values(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of one tree for each row."""
    return Forest.of([nodes], 0.0, x.shape[1]).margins(x)


def path_shares(follow: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1, for rows (pattern, feature) of whether they follow its path.

    If the features of a subset are known, the leaf counts with the product of ``follow`` over them and of ``shares`` over the others. The
    polynomial prod(share + follow * y) has the sum over the subsets of each size as its coefficients; without one feature it is found by
    dividing that feature out, from the top coefficient where the row follows it, else from the bottom.
    """
    patterns, many = follow.shape
    whole = np.zeros((patterns, many + 1))
    whole[:, 0] = 1.0
    for k in range(many):
        whole[:, 1 : k + 2] = whole[:, 1 : k + 2] * shares[k] + whole[:, : k + 1] * follow[:, k : k + 1]
        whole[:, 0] *= shares[k]
    weight = np.array([1 / (many * comb(many - 1, size)) for size in range(many)])
    out = np.zeros((patterns, many))
    for k in range(many):
        yes = follow[:, k] == 1
        rest = np.zeros((patterns, many))
        carry = np.zeros(int(yes.sum()))
        for size in range(many - 1, -1, -1):
            carry = whole[yes, size + 1] - shares[k] * carry
            rest[yes, size] = carry
        if shares[k]:
            rest[~yes] = whole[~yes, :many] / shares[k]
        out[:, k] = (rest @ weight) * (follow[:, k] - shares[k])
    return out


def answers(nodes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of which each stands for all that answer every question of a tree alike, and the place of each row's own among them."""
    inner = nodes[nodes[:, 0] >= 0]
    questions = np.unique(inner[:, :2], axis=0)
    if len(questions) > PACKED:
        asked = np.stack([~(x[:, int(f)] >= threshold) for f, threshold in questions], 1)
        _, first, which = np.unique(np.packbits(asked, axis=1), axis=0, return_index=True, return_inverse=True)
        return first, which.ravel()
    code = np.zeros(len(x), np.uint16)
    for k, (f, threshold) in enumerate(questions):
        # A missing value is not at or above the threshold.
        code |= (x[:, int(f)] >= threshold).astype(np.uint16) << np.uint16(k)
    first = np.full(1 << len(questions), -1)
    first[code] = np.arange(len(x))
    seen = np.flatnonzero(first >= 0)
    place = np.zeros(len(first), np.int32)
    place[seen] = np.arange(len(seen))
    return first[seen], place[code]


def tree_shapley(nodes: np.ndarray, x: np.ndarray, out: np.ndarray) -> float:
    """Add each feature's exact Shapley value of one tree to ``out``; returns the tree's expected value.

    Rows that answer all questions of the tree alike have the same values, which are found once.
    """
    if not len(x):
        return _shapley(nodes, x, out)
    for begin in range(0, len(x), ROWS):
        part = x[begin : begin + ROWS]
        first, which = answers(nodes, part)
        found = np.zeros((len(first), x.shape[1]))
        expected = _shapley(nodes, part[first], found)
        out[begin : begin + ROWS] += found[which]
    return expected


def _shapley(nodes: np.ndarray, x: np.ndarray, out: np.ndarray) -> float:
    """``tree_shapley`` row by row.

    Features that are not known follow both branches by their shares of cover. Rows that follow the same conditions of a path are one
    pattern, for which its features' values are found by polynomial (``path_shares``), so that cost grows with the square of the depth.
    """
    expected = 0.0
    stack: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
    while stack:
        at, path = stack.pop()
        f, threshold, left, right, value, _ = nodes[at]
        if f < 0:
            names = list(path)
            shares = np.array([path[n][1] for n in names])
            expected += value * float(np.prod(shares))
            if names:
                bits = np.stack([path[n][0] for n in names], 1)
                if len(names) <= LISTED:
                    # All patterns of a short path are listed, so that rows need no sorting.
                    follow, which = (np.arange(1 << len(names))[:, None] >> np.arange(len(names))) & 1, bits @ (1 << np.arange(len(names)))
                else:
                    patterns, which = np.unique(np.packbits(bits, axis=1), axis=0, return_inverse=True)
                    follow = np.unpackbits(patterns, axis=1, count=len(names))
                out[:, names] += value * path_shares(follow.astype(float), shares)[which.ravel()]
            continue
        f, v = int(f), x[:, int(f)]
        goes_left = np.isnan(v) | (v < threshold)
        total = nodes[int(left), 5] + nodes[int(right), 5]
        for child, goes in ((int(left), goes_left), (int(right), ~goes_left)):
            follow, share = path.get(f, (True, 1.0))
            stack.append((child, path | {f: (follow & goes, share * nodes[child, 5] / total)}))
    return expected
