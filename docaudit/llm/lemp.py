"""Large inner products of a chunk of query vectors with a block of rows: length buckets, sorted coordinate lists, feasible ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LEAST, MOST = -(1 << 62), 1 << 62
#: A new bucket begins where a length falls below this share of the bucket's longest.
LENGTHS = 0.9
#: So many coordinates of a query, the largest by amount, are looked up in the lists.
FOCUS = 4
#: Where the ranges, taken as independent, would still leave more than this share of a bucket, the bucket is verified whole.
WHOLE = 0.5
#: Angles are widened by so much for rounding.
SLACK = 1e-7


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products (int64) of the rows of a with the rows of b."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


@dataclass
class Bucket:
    """Rows of similar length; by coordinate, the unit vectors' values in order and the rows they belong to."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    longest: float
    unit: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)
    values: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        lengths = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.unit = self.vectors / np.where(lengths > 0, lengths, 1)[:, None]
        self.rows = np.argsort(self.unit, axis=0, kind="stable")
        self.values = np.take_along_axis(self.unit, self.rows, 0)


def buckets(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list[Bucket]:
    """The rows of a block as buckets, the longest first."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((ids, -lengths))
    ids, labels, vectors, lengths = ids[order], labels[order], vectors[order], lengths[order]
    out, first = [], 0
    while first < len(ids):
        end = int(np.searchsorted(-lengths, -LENGTHS * lengths[first], side="right")) if lengths[first] > 0 else len(ids)
        out.append(Bucket(ids[first:end], labels[first:end], vectors[first:end], float(lengths[first])))
        first = end
    return out


@dataclass
class Chunk:
    """Query vectors and what is wanted for them: the k best rows whose product lies from low to high, of the same label or of another.

    best holds (product, id) of each want as found so far, the better first; it lives on from block to block.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    query: np.ndarray
    tag: np.ndarray
    tag_score: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool
    verified: int = 0
    pairs: int = 0

    def __post_init__(self) -> None:
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.query]
        self.floor = self.low.copy()
        self.lengths = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.unit = self.vectors / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.wants: list[list[int]] = [[] for _ in self.ids]
        for w, q in enumerate(self.query):
            if self.low[w] <= self.high[w]:
                self.wants[q].append(w)

    def least(self) -> np.ndarray:
        """By query, the smallest product that can still be of use; MOST where none is wanted."""
        return np.array([min((int(self.floor[w]) for w in wants), default=MOST) for wants in self.wants], np.float64)

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offers exact products of a query; ids are those rows' ids, all of a label that fits."""
        for w in self.wants[q]:
            at = np.flatnonzero((scores >= self.floor[w]) & (scores <= self.high[w]))
            if len(at):
                at = at[np.lexsort((ids[at], -scores[at]))[: self.k]]
                best = sorted([*self.best[w], *((-int(s), int(i)) for s, i in zip(scores[at], ids[at], strict=True))])[: self.k]
                self.best[w] = best
                if len(best) == self.k:
                    self.floor[w] = max(self.floor[w], -best[-1][0])

    def search(self, bucket: Bucket) -> None:
        """Offers all rows of the bucket whose product with a query can reach what is still of use."""
        n, least = len(bucket.ids), self.least()
        self.pairs += n * len(self.ids)
        reach = self.lengths * bucket.longest
        # A product of theta needs a cosine of theta / (|query| * longest); a positive one cannot come of a vector of zeros.
        cosine = np.where(least <= 0, -1.0, least / np.where(reach > 0, reach, 1e-300))
        alive = np.flatnonzero((least < MOST) & (cosine <= 1 + SLACK))
        if not len(alive):
            return
        focus, x = self.focus[alive], np.take_along_axis(self.unit[alive], self.focus[alive], 1)
        own, reach = np.arccos(np.clip(x, -1, 1)), np.arccos(np.clip(cosine[alive], -1, 1))[:, None] + SLACK
        # A row within the angle `reach` of the query has, to each axis, an angle within `reach` of the query's.
        lower, upper = np.cos(np.minimum(np.pi, own + reach)) - SLACK, np.cos(np.maximum(0, own - reach)) + SLACK
        first, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            first[at] = np.searchsorted(bucket.values[:, f], lower[at], "left")
            end[at] = np.searchsorted(bucket.values[:, f], upper[at], "right")
        narrow = (end - first).argmin(1)
        whole = np.flatnonzero((((end - first) / n).prod(1) > WHOLE) | (cosine[alive] <= 0))
        for part in np.array_split(whole, len(whole) // 256 + 1):
            scores = product(self.vectors[alive[part]], bucket.vectors)
            self.verified += scores.size
            for q, row in zip(alive[part], scores, strict=True):
                at = np.flatnonzero(self._fits(q, bucket.labels, bucket.ids))
                self.take(q, row[at], bucket.ids[at])
        for j in np.setdiff1d(np.arange(len(alive)), whole):
            q, f = alive[j], focus[j, narrow[j]]
            at = bucket.rows[first[j, narrow[j]] : end[j, narrow[j]], f]
            for g in range(focus.shape[1]):
                if g != narrow[j]:
                    value = bucket.unit[at, focus[j, g]]
                    at = at[(value >= lower[j, g]) & (value <= upper[j, g])]
            at = at[self._fits(q, bucket.labels[at], bucket.ids[at])]
            self.verified += len(at)
            if len(at):
                self.take(q, product(self.vectors[q : q + 1], bucket.vectors[at])[0], bucket.ids[at])

    def _fits(self, q: int, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (labels == self.labels[q]) & (ids != self.ids[q]) if self.same else labels != self.labels[q]

    def found(self) -> list[tuple[int, int, int, int, int]]:
        """(query id, tag, tag's score, product, row id)."""
        return [(int(self.ids[q]), int(self.tag[w]), int(self.tag_score[w]), -s, i) for w, q in enumerate(self.query) for s, i in self.best[w]]
