"""Periodic run detection (operator 11): block convolution.

A run is a stretch of words with smallest period q, at least ``max(shortest,
2q)`` long, that no neighbouring word extends. Its words i and i + q are equal
for at least q (and ``shortest - q``) consecutive i, so at the dyadic scale
whose distances hold q that stretch covers a whole aligned block:

1. Words are numbered and mapped to small integers. At scale B = 2, 4, 8, ...
   blocks start at multiples of B and are B words long (``BLOCK`` at most); the
   windows that follow hold the distances 2B - 1 to 4B - 2 (1 to 6 at B = 2;
   where runs may be shorter than five words, B = 1 goes before it).
2. The squared differences of a block and every place of its window sum to
   |block|^2 + |window place|^2 - 2 * correlation, and the correlations are a
   number-theoretic transform modulo ``PRIME``: transforms of up to 128 points
   are products with constant matrices, whose sums stay below 2**53 and are
   exact in floating point. The sums stay below the prime, so zero means zero:
   each zero is an occurrence of the block at that distance.
3. Distances of neighbouring blocks are joined and extended word by word (on
   the word numbers, so two words of one small integer do not pass) to the
   maximal stretch. Zeros that a known run explains (both ends inside it, the
   distance a multiple of its period) are not followed; of stretches with the
   same ends the smallest period stands, which is exact by the theorem of Fine
   and Wilf.

Blocks that hold a word which does not come again far enough on in its text
have no zero and are not transformed. Beyond B = ``BLOCK`` blocks keep their
length and windows are tiled, so each scale costs about the same per word and
the whole O(n log n), whatever the text's length. Blocks are transformed
``AT_ONCE`` at a time; a task holds one slice of texts (``common.SLICE_BYTES``, or one
longer text). No shuffle; rows stay with their documents.

Defined cases: a null or empty text, or one without a word, has no run and an
empty collapsed text; repeated rows, null ids and ties keep their rows; runs
are ordered by start, then period; an empty table gives an empty result; only
id and text are read, so extra columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import Words, map_arrow, mix, slices, strings

SHORTEST = 12
BLOCK = 32
PRIME, ROOT = 7_340_033, 3  # 7 * 2**20 + 1 and a generator
SMALL = 400  # small integers a word is mapped to; BLOCK * SMALL**2 < PRIME
AT_ONCE = 1 << 13

_MATRICES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _centred(x: np.ndarray) -> np.ndarray:
    return np.where(x > PRIME // 2, x - PRIME, x).astype(np.float64)


def _matrices(block: int, points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform of a block (reversed, so that products correlate), of a
    window, and back for the places that do not wrap around."""
    if (block, points) not in _MATRICES:
        w = pow(ROOT, (PRIME - 1) // points, PRIME)
        power = np.array([pow(w, k, PRIME) for k in range(points)], np.int64)
        k = np.arange(points)
        there, back = power[np.outer(k, k) % points], power[-np.outer(k, k) % points]
        scaled = back * pow(points, -1, PRIME) % PRIME
        _MATRICES[block, points] = (_centred(back[:block]), _centred(there), _centred(scaled[:, : points - block + 1]))
    return _MATRICES[block, points]


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, centred, in place; exact below 2**53."""
    q = x * (1.0 / PRIME)
    np.rint(q, out=q)
    q *= PRIME
    x -= q
    return x


def occurrences(small: np.ndarray, starts: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all zero-mismatch occurrences of the blocks at
    ``starts`` at distances low to high. ``small`` is padded behind its end."""
    points = 1 << (min(high - low, 3 * block) + block - 1).bit_length()
    front, there, back = _matrices(block, points)
    places = back.shape[1]
    squares = np.concatenate([[0.0], np.cumsum(small * small)])
    found = []
    for lo in range(0, len(starts), AT_ONCE):
        at = starts[lo: lo + AT_ONCE]
        a = _modulo(small[at[:, None] + np.arange(block)] @ front)
        a_square = squares[at + block] - squares[at]
        for d in range(low, high + 1, places):
            first = at + d
            width = min(places, high + 1 - d)
            spread = _modulo(small[first[:, None] + np.arange(points)] @ there)
            spread *= a
            both = _modulo(_modulo(spread) @ back[:, :width])
            places_at = first[:, None] + np.arange(width)
            gap = a_square[:, None] + squares[places_at + block] - squares[places_at]
            both *= 2
            gap -= both  # the sum of squared differences, up to a multiple of the prime
            i, o = np.nonzero(_modulo(gap) == 0)
            found.append((at[i], o + d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Runs:
    """Runs of the texts of one slice: arrays ``doc``, ``start`` (in the flat
    words), ``length``, ``period``, ordered by document, start, period."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, n: np.ndarray, first: np.ndarray, shortest: int = SHORTEST):
        self.codes, self.doc, self.first, self.n, self.shortest = codes, doc, first, n, shortest
        self.known: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        if len(codes) and n.max() >= shortest:
            self._search()
        rows = np.array([(s, e - s, p) for (s, e), p in self.known.items()], np.int64).reshape(-1, 3)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        self.start, self.length, self.period = rows.T
        self.of = doc[self.start] if len(rows) else np.zeros(0, np.int64)

    def _search(self) -> None:
        total = len(self.codes)
        longest = int(self.n.max())
        pad = 8 * BLOCK + 4
        # the word's last place in its text, less its own: how far on it comes again
        order = np.lexsort((self.doc, self.codes))
        c, d = self.codes[order], self.doc[order]
        last = np.append((c[1:] != c[:-1]) | (d[1:] != d[:-1]), True)
        ends = np.flatnonzero(last)
        reach = np.empty(total, np.int64)
        reach[order] = np.repeat(order[ends], np.diff(np.concatenate([[-1], ends])))
        reach -= np.arange(total)
        hashed = (mix(self.codes) % np.uint64(SMALL)).astype(np.float64)
        # periods 1 and 2 of runs of five words or more cover a block of two words
        smallest = scale = 2 if self.shortest >= 5 else 1
        while True:
            block = min(scale, BLOCK)
            low, high = 1 if scale == smallest else 2 * scale - 1, 4 * scale - 2
            if max(self.shortest, 2 * low) > longest:
                return
            starts = np.arange(0, total - block + 1, scale)
            ok = (self.doc[starts] == self.doc[starts + block - 1]) & (self.n[self.doc[starts]] >= 2 * low)
            starts = starts[ok]
            if len(starts):
                far = reach[starts[:, None] + np.arange(block)].min(1) >= low
                starts = starts[far]
            if len(starts):
                width = pad + min(high, longest) + 4 * BLOCK
                small = np.concatenate([hashed, np.zeros(width)])
                at, q = occurrences(small, starts, block, low, min(high, longest))
                if len(at):
                    self._follow(at, q, block, scale)
            scale *= 2

    def _follow(self, at: np.ndarray, q: np.ndarray, block: int, scale: int) -> None:
        inside = at + q + block <= (self.first + self.n)[self.doc[at]]
        at, q = self._unexplained(at[inside], q[inside], block)
        if not len(at):
            return
        order = np.lexsort((at, q))
        at, q = at[order], q[order]
        # neighbouring blocks at one distance are one stretch
        new = np.ones(len(at), bool)
        new[1:] = (q[1:] != q[:-1]) | (at[1:] - at[:-1] != scale) | (self.doc[at[1:]] != self.doc[at[:-1]])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        for s, e, d in zip(at[heads].tolist(), (at[tails] + block).tolist(), q[heads].tolist(), strict=True):
            self._extend(s, e, d, scale + block)

    def _unexplained(self, at: np.ndarray, q: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Without the zeros that lie in a known run and are multiples of its
        period."""
        if not self.known:
            return at, q
        order = np.argsort(at, kind="stable")
        at, q = at[order], q[order]
        keep = np.ones(len(at), bool)
        for (s, e), p in self.known.items():
            lo, hi = np.searchsorted(at, [s, e - block])
            if lo < hi:
                keep[lo:hi] &= ~((at[lo:hi] + q[lo:hi] + block <= e) & (q[lo:hi] % p == 0))
        return at[keep], q[keep]

    def _extend(self, s: int, e: int, q: int, margin: int) -> None:
        """Maximal stretches of words equal at distance q around [s, e)."""
        doc = self.doc[s]
        floor, ceiling = int(self.first[doc]), int(self.first[doc] + self.n[doc]) - q
        known = self.known
        left, right = max(floor, s - margin), min(ceiling, e + margin)
        while True:
            same = self.codes[left:right] == self.codes[left + q: right + q]
            if same[0] and left > floor:
                left = max(floor, left - margin)
            elif same[-1] and right < ceiling:
                right = min(ceiling, right + margin)
            else:
                break
            margin *= 2
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = b - a + q
            if length >= self.shortest and length >= 2 * q:
                key = (left + a, left + a + length)
                if q < known.get(key, q + 1):
                    known[key] = q

    def dropped(self) -> np.ndarray:
        """Mask of the words that some run holds after its first period."""
        edge = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(edge, self.start + self.period, 1)
        np.add.at(edge, self.start + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def detect(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length,
    period; by start, then period), collapsed (words that no run holds after
    its first period, joined by one space)."""
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def kernel(batches):
        for b in batches:
            texts, ids = strings(b.column("text")), b.column("doc_id")
            for lo, hi in slices(texts):
                w = Words(texts.slice(lo, hi - lo))
                r = Runs(w.codes, w.doc, w.n, w.start, shortest)
                kept = np.flatnonzero(~r.dropped()) if len(r.start) else np.arange(len(w.codes))
                words = w.flat.take(pa.array(kept)) if len(kept) < len(w.codes) else w.flat
                bounds = np.searchsorted(w.doc[kept], np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words)
                begin = r.start - w.start[r.of] if len(r.start) else r.start
                found = pa.StructArray.from_arrays([pa.array(begin), pa.array(r.length), pa.array(r.period)],
                                                   fields=list(entry))
                of = np.searchsorted(r.of, np.arange(hi - lo + 1))
                yield pa.record_batch({
                    "doc_id": ids.slice(lo, hi - lo), "n_words": pa.array(w.n),
                    "runs": pa.ListArray.from_arrays(pa.array(of, pa.int32()), found),
                    "collapsed": pc.binary_join(lists, " ")})

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel,
                     "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
                     "collapsed string")
