"""Recursive graph bisection: an order of documents in which neighbours share terms.

Documents and terms are a bipartite graph. A set of documents is cut into two halves; pairs from both are swapped as
long as that lowers the estimated size of gaps in the posting lists, the sum over terms of d * log2(n / (d + 1)) for
a half's n documents, d of which hold the term. Each half is cut again down to the wanted size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 8


@dataclass
class Graph:
    """Postings: term[i] is in document doc[i], with documents in ascending order; both count from 0."""

    term: np.ndarray
    doc: np.ndarray
    n_docs: int
    n_terms: int

    def part(self, chosen: np.ndarray) -> Graph:
        """Of the chosen documents (a mask), numbered anew; terms keep their numbers."""
        mine = chosen[self.doc]
        new = np.cumsum(chosen) - 1
        return Graph(self.term[mine], new[self.doc[mine]], int(chosen.sum()), self.n_terms)


def frequent(term: np.ndarray, doc: np.ndarray, n_docs: int, n_terms: int) -> Graph:
    """Without terms of a single document, which cost the same on either side."""
    mine = np.bincount(term, minlength=n_terms)[term] > 1
    kept, compact = np.unique(term[mine], return_inverse=True)
    return Graph(compact.astype(np.int64), doc[mine].astype(np.int64), n_docs, len(kept))


def halves(g: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mask of the documents in the first half, and how many documents of each half hold each term. The start is
    an order by each document's smallest term, so that copies begin side by side."""
    smallest = np.full(g.n_docs, g.n_terms)
    np.minimum.at(smallest, g.doc, g.term)
    left = np.zeros(g.n_docs, bool)
    left[np.argsort(smallest, kind="stable")[: g.n_docs // 2]] = True
    sizes = int(left.sum()), g.n_docs - int(left.sum())
    d = np.arange(g.n_docs + 2)
    cost = [d * (np.log2(max(n, 1)) - np.log2(d + 1)) for n in sizes]
    for r in range(ROUNDS + 1):
        mine = left[g.doc]
        a, b = np.bincount(g.term[mine], minlength=g.n_terms), np.bincount(g.term[~mine], minlength=g.n_terms)
        if r == ROUNDS:
            break
        now = cost[0][a] + cost[1][b]
        gain = np.where(mine, (now - cost[0][np.maximum(a - 1, 0)] - cost[1][b + 1])[g.term], (now - cost[0][a + 1] - cost[1][np.maximum(b - 1, 0)])[g.term])
        of = np.bincount(g.doc, gain, g.n_docs)
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        x, y = x[np.argsort(-of[x], kind="stable")], y[np.argsort(-of[y], kind="stable")]
        m = min(len(x), len(y))
        n = int((of[x[:m]] + of[y[:m]] > 1e-9).sum())
        if not n:
            break
        left[x[:n]], left[y[:n]] = False, True
    return left, a, b


def reorder(g: Graph, most: int) -> np.ndarray:
    """Documents in their new order: runs of at most `most` come from one half of halves."""
    if g.n_docs <= most:
        return np.arange(g.n_docs)
    left, *_ = halves(g)
    return np.concatenate([np.flatnonzero(m)[reorder(g.part(m), most)] for m in (left, ~left)])


class Routes:
    """The cuts of a sample as a tree that sends any document to one of 2 ** depth leaves: at each cut to the half in
    which its terms are more frequent."""

    def __init__(self, g: Graph, names: np.ndarray, depth: int) -> None:
        """names: the sorted hashes of the graph's terms."""
        self.names, self.depth = names, depth
        self.weight = np.zeros((max(1, (1 << depth) - 1), len(names)), np.float32)
        self._cut(g, 0, depth)

    def _cut(self, g: Graph, node: int, depth: int) -> None:
        if not depth or not g.n_docs:
            return
        left, a, b = halves(g)
        n, m = max(1, int(left.sum())), max(1, int((~left).sum()))
        self.weight[node] = np.log2((a + 1) / (n + 2)) - np.log2((b + 1) / (m + 2))
        self._cut(g.part(left), 2 * node + 1, depth - 1)
        self._cut(g.part(~left), 2 * node + 2, depth - 1)

    def leaf(self, names: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """The leaf of each document; names: hashes of the terms of its postings."""
        node = np.zeros(n_docs, np.int64)
        if self.depth and len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            known = self.names[at] == names
            at, doc = at[known], doc[known]
            for _ in range(self.depth):
                right = np.bincount(doc, self.weight[node[doc], at], n_docs) < 0
                node = 2 * node + 1 + right
            return node - ((1 << self.depth) - 1)
        return node
