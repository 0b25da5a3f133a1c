"""Recursive graph bisection: documents in an order that keeps those with the same terms together."""

from __future__ import annotations

import numpy as np

#: Rounds of swaps in one bisection at most; it ends earlier once hardly a swap gains.
ROUNDS = 8


def gap_cost(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits for the gaps of a term that `degree` of `size` documents hold."""
    return degree * np.log2(max(size, 1) / (degree + 1.0))


def added(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits that one more document with the term costs."""
    return gap_cost(degree + 1, size) - gap_cost(degree, size)


class Postings:
    """The terms of documents: those of document d are terms[start[d]:start[d + 1]], numbers below `width`."""

    def __init__(self, start: np.ndarray, terms: np.ndarray, width: int):
        self.start, self.terms, self.width = start, terms, width

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of these documents, and for each the place in docs of its document."""
        size = self.start[docs + 1] - self.start[docs]
        owner = np.repeat(np.arange(len(docs)), size)
        return self.terms[np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[docs], size)], owner


def bisect(held: Postings, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two halves of docs, then the terms that several of them hold and how many documents of each half hold each.

    A round gives every document the bits that moving it to the other half would save; the best of either half
    change places as long as both moves together save any. Ties leave documents in the order they came in.
    """
    half = (len(docs) + 1) // 2
    side = np.arange(len(docs)) >= half
    terms, owner = held.of(docs)
    count = np.bincount(terms, minlength=held.width)
    names = np.flatnonzero(count > 1)  # a term of one document says nothing
    number = np.full(held.width, -1, np.int32)
    number[names] = np.arange(len(names))
    terms = number[terms]
    owner, terms, count = owner[terms >= 0], terms[terms >= 0], count[names]
    sizes, width = (half, len(docs) - half), len(names)
    for _ in range(ROUNDS):
        right = side[owner]
        over = np.bincount(terms[right], minlength=width)
        degree = count - over, over
        # What a document saves by leaving its half for the other: for each term in the left half, then in the right.
        leave = np.concatenate([added(np.maximum(degree[s] - 1, 0), sizes[s]) - added(degree[1 - s], sizes[1 - s]) for s in (0, 1)])
        gain = np.bincount(owner, weights=leave[terms + width * right], minlength=len(docs))
        here, there = np.flatnonzero(~side), np.flatnonzero(side)
        here, there = here[np.argsort(-gain[here], kind="stable")], there[np.argsort(-gain[there], kind="stable")]
        pairs = min(len(here), len(there))
        swap = gain[here[:pairs]] + gain[there[:pairs]] > 1e-9
        if swap.sum() <= len(docs) // 400:
            break
        side[here[:pairs][swap]], side[there[:pairs][swap]] = True, False
    over = np.bincount(terms[side[owner]], minlength=width)
    return docs[~side], docs[side], names, count - over, over


def order(held: Postings, docs: np.ndarray, least: int) -> np.ndarray:
    """docs reordered; parts of up to `least` documents are not cut any more."""
    done, open_ = [], [docs]
    while open_:
        part = open_.pop()
        if len(part) <= least:
            done.append(part)
        else:
            left, right, *_ = bisect(held, part)
            open_ += [right, left]
    return np.concatenate(done) if done else docs


class Tree:
    """Bisections of a sample, level by level, that any other document can be sent down."""

    def __init__(self, held: Postings, depth: int):
        self.depth = depth
        #: For each node and term, the bits that a document with it saves in the right half.
        self.weight = np.zeros(((1 << depth) - 1, held.width), np.float32)
        parts = [np.arange(len(held.start) - 1)]
        for level in range(depth):
            below = []
            for i, part in enumerate(parts):
                left, right, names, in_left, in_right = bisect(held, part) if len(part) > 1 else (part, part[:0], *[np.zeros(0, np.int64)] * 3)
                if len(right):
                    self.weight[(1 << level) - 1 + i, names] = added(in_left, len(left)) - added(in_right, len(right))
                below += [left, right]
            parts = below

    def leaves(self, terms: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """The leaf of each of `count` documents, whose known terms are given with their documents."""
        node = np.zeros(count, np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.bincount(owner, weights=self.weight[node[owner], terms], minlength=count) > 0)
        return node - ((1 << self.depth) - 1)
