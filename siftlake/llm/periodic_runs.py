"""Periodic run detection: stretches of words that repeat with a period, found by suffix trees.

A run is a maximal stretch of words with smallest period q whose length is at least ``least_exponent`` periods and
``least_words`` words. For each document:

1. Parts that no run can touch are set aside. A stretch of four periods or more, and six words or more, holds each of
   its three-word grams at least three times; a word whose grams are all rarer lies in no run. Each such stretch becomes
   one letter that occurs nowhere else, so nothing is extended over it. This is exact, and spares plain prose its trees.
2. Ukkonen's algorithm builds the suffix tree of what is left, and that of its reversal, over the words as letters.
3. An Euler tour of each tree, with minima of blocks, tells the depth of the lowest common ancestor of two leaves in
   constant time: how far two suffixes (or two prefixes, by the reversal) agree.
4. Every run has a Lyndon root, for the order of letters or for its reverse, that is the longest Lyndon word at its place;
   it ends where the next smaller suffix begins. Each such root is a candidate, extended in both directions.

Memory is some hundred bytes a word of the one document at hand. There is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from siftlake.llm.common import arrow_map

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GRAM, TIMES = 3, 3
#: Euler tours are cut into blocks of so many visits.
BLOCK = 32


def words_of(doc_id: int | None, text: str) -> list[str]:
    return WORD.findall(text)


class SuffixTree:
    """Ukkonen's tree of a list of letters 1..size-1; letter 0 ends it, so that each suffix has a leaf.

    Inner nodes are numbered from the root, 0; the leaf of the suffix at k is -1-k.
    """

    def __init__(self, letters: list[int], size: int):
        self.letters, self.size = [*letters, 0], size
        edges, depth = self._build()
        keys, self._children = (np.fromiter(x, dtype=np.int64, count=len(edges)) for x in (edges.keys(), edges.values()))
        self._parents, self._firsts = keys // size, keys % size
        self._tour(np.array(depth, dtype=np.int32))

    def _build(self) -> tuple[dict[int, int], list[int]]:
        """Children by node and first letter, and the inner nodes' depths in letters."""
        s, size = self.letters, self.size
        start, end, link, depth, leaf, edges = [0], [0], [0], [0], [], {}
        node = at = length = waiting = 0  # the active point: node, first letter of the edge, letters along it
        for i, c in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    at = i
                key = node * size + s[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = ~len(leaf)
                    leaf.append(i)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    if child < 0:  # a leaf's edge goes on to the present end
                        first = leaf[~child]
                    else:
                        first = start[child]
                        long = end[child] - first
                        if length >= long:
                            node = child
                            at += long
                            length -= long
                            continue
                    fork = first + length
                    if s[fork] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    start.append(first)
                    end.append(fork)
                    link.append(0)
                    depth.append(waiting - 1)
                    if child < 0:
                        leaf[~child] = fork
                    else:
                        start[child] = fork
                    edges[key] = middle
                    edges[middle * size + s[fork]] = child
                    edges[middle * size + c] = ~len(leaf)
                    leaf.append(i)
                    if last:
                        link[last] = middle
                    last = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - waiting + 1
        return edges, depth

    def _visited(self, rank_of_letter: np.ndarray) -> np.ndarray:
        """Nodes in the order of a depth-first walk that takes children by ``rank_of_letter``."""
        order = np.lexsort((-rank_of_letter[self._firsts], self._parents))  # the stack is taken from its end
        children = self._children[order].tolist()
        begin = np.searchsorted(self._parents[order], np.arange(self._parents.max() + 2)).tolist()
        out, stack = [], [0]
        while stack:
            v = stack.pop()
            out.append(v)
            if v >= 0:
                stack += children[begin[v] : begin[v + 1]]
        return np.array(out, dtype=np.int64)

    def _tour(self, depth: np.ndarray) -> None:
        """The Euler tour's turning points: between two leaves it climbs to their ancestor, the parent of the node visited next."""
        walk = self._visited(np.arange(self.size))
        above = np.zeros(len(self.letters) + len(depth), dtype=np.int32)  # depth of each node's parent; leaves from the end
        above[self._children] = depth[self._parents]
        leaves = np.flatnonzero(walk < 0)
        turns = above[walk[leaves[:-1] + 1]]
        self.rank = np.empty(len(leaves), dtype=np.int64)
        self.rank[~walk[leaves]] = np.arange(len(leaves))
        self._flat = np.full(max(1, -(-len(turns) // BLOCK)) * BLOCK, len(self.letters), dtype=np.int32)
        self._flat[: len(turns)] = turns
        blocks = self._flat.reshape(-1, BLOCK)
        self._before = np.minimum.accumulate(blocks, axis=1).ravel()
        self._after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self._table = [blocks.min(axis=1)]
        while (half := 1 << (len(self._table) - 1)) * 2 <= len(blocks):
            self._table.append(np.minimum(self._table[-1][:-half], self._table[-1][half:]))

    def reverse_rank(self) -> np.ndarray:
        """Places of the suffixes in the reverse order of letters; as in ``rank``, a prefix comes before what it begins."""
        walk = self._visited((self.size - np.arange(self.size)) % self.size)
        leaves = ~walk[walk < 0]
        places = np.empty(len(leaves), dtype=np.int64)
        places[leaves] = np.arange(len(leaves))
        return places

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters the suffixes at ``a`` and ``b`` (different ones) begin with alike: the depth of the leaves' lowest common ancestor."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b]) - 1
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self._after[low], self._before[high])
        inner = last - first - 1
        for level, table in enumerate(self._table):
            pick = np.flatnonzero((inner >> level) == 1)
            out[pick] = np.minimum(out[pick], np.minimum(table[first[pick] + 1], table[last[pick] - (1 << level)]))
        for k in np.array_split(same := np.flatnonzero(first == last), len(same) // 50_000 + 1):
            spread = low[k][:, None] + np.arange(BLOCK)
            inside = spread <= high[k][:, None]
            out[k] = np.where(inside, self._flat[np.where(inside, spread, 0)], len(self.letters)).min(axis=1)
        return out.astype(np.int64)


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each place but the last (the end's own), the next one of a smaller rank: where its longest Lyndon word ends."""
    ranks = ranks.tolist()
    out, stack = [0] * (len(ranks) - 1), []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, dtype=np.int64)


def tree_runs(letters: list[int], size: int, least_words: int, least_exponent: int) -> np.ndarray:
    """Rows start, length, period of the runs, by start and then period."""
    n = len(letters)
    forward, backward = SuffixTree(letters, size), SuffixTree(letters[::-1], size)
    found = []
    for ranks in (forward.rank, forward.reverse_rank()):
        # The end comes before all letters in either order, so the last letter's word ends there.
        j = next_smaller(ranks)
        i = np.flatnonzero((j - np.arange(n)) * least_exponent <= n)
        j = j[i]
        low, high = i - backward.common(n - i, n - j), j + forward.common(i, j)
        found.append(np.stack([low, high - low, j - i], axis=1))
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= np.maximum(least_words, least_exponent * rows[:, 2])]
    return np.unique(rows[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def runs_in(words: list[str], least_words: int = 6, least_exponent: int = 4) -> np.ndarray:
    """Rows start, length, period of the runs of ``words``, by start and then period."""
    if least_exponent < 4 or least_words < 6:
        raise ValueError("runs of fewer than six words or four periods are not told by their three-word grams")
    none = np.zeros((0, 3), dtype=np.int64)
    if len(words) < least_words:
        return none
    ids = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
    codes = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
    mixed = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    grams = mixed[:-2] + (mixed[1:-1] << np.uint64(21) | mixed[1:-1] >> np.uint64(43)) + (mixed[2:] << np.uint64(42) | mixed[2:] >> np.uint64(22))
    order = np.argsort(grams)
    sorted_grams = grams[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1], [True]]))
    often = np.zeros(len(grams), dtype=bool)  # grams that share a hash only add to what the trees are built of
    often[order] = np.repeat(np.diff(edge) >= TIMES, np.diff(edge))
    bounds = np.flatnonzero(np.diff(np.concatenate([[0], often, [0]])))
    parts = [(low, high + GRAM - 1) for low, high in bounds.reshape(-1, 2).tolist() if high + GRAM - 1 - low >= least_words]
    if not parts:
        return none
    letters, places, size = [], [], len(ids) + 1
    for low, high in parts:
        letters += [*codes[low:high].tolist(), size]
        places.append(np.arange(low, high + 1))
        size += 1
    _, dense = np.unique(letters, return_inverse=True)
    rows = tree_runs((dense + 1).tolist(), int(dense.max()) + 2, least_words, least_exponent)
    rows[:, 0] = np.concatenate(places)[rows[:, 0]]
    return rows


def dropped(rows: np.ndarray, n: int) -> np.ndarray:
    """True for each of ``n`` words that a run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_exponent: int = 4, words_of: Callable[[int | None, str], list[str]] = words_of
) -> DataFrame:
    """The runs of each document, by start and then period, and its text without their repetitions.

    Returns ``id_col``, ``n_words`` long, ``runs`` array<struct<start,length,period>> (word numbers from 0) and ``collapsed``: the words
    that no run holds after its first period, joined by one space. ``words_of(id, text)`` may edit the words first.
    One row for each row given, repeated ids and null ids included; a null or empty text has no words, no runs and an empty
    ``collapsed``; ties need no rule, since all runs are returned; an empty table gives no rows; further columns are not read.
    """

    def make():
        def step(batch):
            out = {"id": batch.column(0), "n_words": [], "runs": [], "collapsed": []}
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = words_of(doc_id.as_py(), text.as_py() or "")
                rows = runs_in(words, least_words, least_exponent)
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in rows.tolist()])
                kept = [w for w, gone in zip(words, dropped(rows, len(words)).tolist()) if not gone] if len(rows) else words
                out["collapsed"].append(" ".join(kept))
            return out

        return step

    kind = dict(docs.dtypes)[id_col]
    found = arrow_map(docs.select(id_col, text_col), make, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
