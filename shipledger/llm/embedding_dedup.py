"""Embedding near-dedup (operator 1): inverted multi-index.

1. Equal vectors are one class (hash, then map-side grouping); a class is
   searched once and counts with its number of rows.
2. Two codebooks, one for each half of the vector, are fitted on a bounded
   sample (``SAMPLE`` classes, hash order) and form a product grid. Every class
   is put into the cell of its nearest centroid pair.
3. Multi-sequence traversal: for each vector both halves' centroids are sorted
   by distance, and cells are visited in rising order of the summed squared
   distance, up to a gap over the nearest cell. The gap is calibrated so that a
   vector turned by exactly the threshold's angle in a random direction falls
   into a visited cell with probability ``recall``; closer pairs are found more
   often. Only cells from the own one on (in cell order) are visited, so
   each pair is met once.
4. Verification: members of a cell against the vectors that visit it, in
   blocks, as matrix products in double precision. Cells with many members or
   visitors are split into blocks of both (every block pair is a unit), so no
   task holds an unbounded group. A unit puts out, per vector, its number of
   links and one edge to a group mate, never all pairs.
5. Connected components by star contraction.

What is broadcast is the codebooks (at most 2 x ``MOST`` centroids) and one row
a cell (at most ``MOST`` squared).

Defined cases: vectors that are null, zero or hold null or non-finite
components keep their row, link with nothing and are their own component;
vectors of another length than the most frequent in the sample are compared
only with vectors of their length, in one cell split into blocks; repeated
rows and copies count as further vectors; a null vec_id keeps its row, takes
its component's smallest id and is not kept; an empty table gives an empty
result; only id and vector are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import map_arrow, written
from shipledger.llm.graph import components
from shipledger.llm.streams import runs

SAMPLE, MOST, PER_CELL = 16_384, 1024, 256
MEMBERS, VISITORS = 512, 2048  # rows of a unit's block
NO_ID = 1 << 62  # from here on: classes of vectors without an id


def codebook(x: np.ndarray, k: int, seed: int, steps: int = 12) -> np.ndarray:
    """Lloyd's algorithm from a seeded sample of the rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        nearest = distances(x, c).argmin(1)
        n = np.bincount(nearest, minlength=len(c))
        for j in range(x.shape[1]):
            s = np.bincount(nearest, weights=x[:, j], minlength=len(c))
            c[:, j] = np.where(n > 0, s / np.maximum(n, 1), c[:, j])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def traverse(d1: np.ndarray, d2: np.ndarray, gap: float) -> np.ndarray:
    """Cells (i * len(d2) + j) whose summed distance is within ``gap`` of the
    nearest cell's, nearest first: the prefix of the multi-sequence order."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1], d2[o2]
    limit = s1[0] + s2[0] + gap
    n = np.searchsorted(s2, limit - s1, side="right")
    n[0] = max(n[0], 1)
    i = np.repeat(np.arange(len(s1)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(s1[i] + s2[j], kind="stable")
    return (o1[i] * len(d2) + o2[j])[order]


class Index:
    """Codebooks for vectors of length ``dim``, and the calibrated gap."""

    def __init__(self, x: np.ndarray, cells_a_side: int, threshold: float, recall: float):
        self.dim = x.shape[1]
        self.half = self.dim // 2
        self.books = [codebook(x[:, : self.half], cells_a_side, 1), codebook(x[:, self.half:], cells_a_side, 2)]
        rng = np.random.default_rng(3)
        q = x[rng.choice(len(x), min(4096, len(x)), replace=False)]
        away = rng.normal(size=q.shape)
        away -= (away * q).sum(1, keepdims=True) * q
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        turned = threshold * q + math.sqrt(max(0.0, 1 - threshold**2)) * away
        at, to = self.tables(q), self.tables(turned)
        gaps = sum(d[np.arange(len(q)), t.argmin(1)] - d.min(1) for d, t in zip(at, to, strict=True))
        self.gap = float(np.quantile(gaps, recall)) + 1e-9

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        return [distances(x[:, : self.half], self.books[0]), distances(x[:, self.half:], self.books[1])]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of each row and the cells that it visits (own one on)."""
        d1, d2 = self.tables(x)
        own = d1.argmin(1) * len(self.books[1]) + d2.argmin(1)
        return own, [np.union1d(c[c >= o], o) for o, c in zip(own, (traverse(a, b, self.gap) for a, b in zip(
            d1, d2, strict=True)), strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to unit length in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, h1, h2; null hashes where the vector cannot link), and
    classes of equal vectors (rep, h1, h2, copies, vec)."""
    v = F.col("vec")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fine &= F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumns({
        "h1": F.when(F.col("fine"), F.xxhash64("vec")), "h2": F.when(F.col("fine"), F.xxhash64(F.lit(7), "vec"))})
    grouped = rows.where("fine").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    rep = F.coalesce("low", F.shiftrightunsigned(F.col("h1"), 2).bitwiseOR(F.lit(NO_ID)))
    return rows.select("vec_id", "h1", "h2"), grouped.select(rep.alias("rep"), "h1", "h2", "copies", "vec")


def build(reps: DataFrame, threshold: float, recall: float, cells_a_side: int | None = None) -> Index | None:
    """Codebooks from a bounded sample. Centroids a side, unless given, follow
    the number of vectors so that a cell holds about ``PER_CELL``."""
    n = reps.count()
    sample = reps.select("h1", "h2", "vec").orderBy("h1", "h2").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    if not len(sample):
        return None
    sizes = np.array([len(x) for x in sample])
    dim = int(np.bincount(sizes).argmax())
    if dim < 2:
        return None
    x = _matrix(sample.filter(pa.array(sizes == dim)))
    k = cells_a_side or int(np.clip(round(math.sqrt(n / PER_CELL)), 2, MOST))
    return Index(x, k, threshold, recall)


def _placed(reps: DataFrame, index: Index | None) -> DataFrame:
    """rep, copies, vec, own cell and visited cells. Vectors of another length
    share the cell -length."""
    def kernel(batches):
        for b in batches:
            vec = b.column("vec")
            sizes = np.diff(vec.offsets.to_numpy())
            own, visits = -sizes.astype(np.int64), [np.array([-s], np.int64) for s in sizes]
            if index is not None and (main := np.flatnonzero(sizes == index.dim)).size:
                cell, cells = index.place(_matrix(vec.take(pa.array(main))))
                own[main] = cell
                for k, c in zip(main.tolist(), cells, strict=True):
                    visits[k] = c
            yield pa.record_batch([b.column("rep"), b.column("copies"), vec, pa.array(own),
                                   pa.array(visits, pa.list_(pa.int64()))],
                                  names=["rep", "copies", "vec", "own", "visits"])

    kind = dict(reps.dtypes)["vec"]
    return map_arrow(reps.select("rep", "copies", "vec"), kernel,
                     f"rep long, copies long, vec {kind}, own long, visits array<long>")


class _Unit:
    """Members of one block of a cell; visitors are streamed past them."""

    def __init__(self, ids, copies, x):
        self.ids, self.copies, self.x = ids, copies, x
        self.links = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))

    def visit(self, ids, copies, x, own, threshold):
        hit = x @ self.x.T >= threshold
        hit &= ~own[:, None] | (ids[:, None] < self.ids[None])  # a pair of one cell is met once
        self.links += copies @ hit
        some = hit.any(1)
        if not some.any():
            return ids[some], np.zeros(0, np.int64), ids[some]
        hit, ids = hit[some], ids[some]
        while True:  # members linked with one visitor share the lowest root
            lowest = np.where(hit, self.root[None], len(self.ids)).min(1)
            low = np.where(hit, lowest[:, None], len(self.ids)).min(0)
            merged = np.arange(len(self.ids))
            np.minimum.at(merged, self.root, np.minimum(self.root, low))
            while (merged[merged] != merged).any():
                merged = merged[merged]
            new = merged[self.root]
            if (new == self.root).all():
                break
            self.root = new
        return ids, (hit * self.copies[None]).sum(1), self.ids[lowest]

    def result(self):
        tied = (self.links > 0) | (self.root != np.arange(len(self.ids)))
        return self.ids[tied], self.links[tied], self.ids[self.root[tied]]


def verified(placed: DataFrame, threshold: float) -> DataFrame:
    """(id, links, mate): links found for a class in one unit, and a class of
    the same group. Sum the links; the edges (id, mate) connect all links."""
    visits = placed.select("rep", "own", F.explode("visits").alias("cell"))
    blocks = lambda n, most: F.ceil(n / F.lit(most)).cast("int")
    members = placed.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("m"))
    plan = written(members.join(visits.groupBy("cell").agg(F.count("*").alias("v")), "cell").select(
        "cell", blocks(F.col("m"), MEMBERS).alias("nm"), blocks(F.col("v"), VISITORS).alias("nv")), "imi-plan")
    small = F.broadcast(plan)  # one row an occupied cell
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    left = (placed.withColumn("cell", F.col("own")).join(small, "cell").withColumn("bm", block("nm", 1))
            .withColumn("bv", up_to("nv")).withColumn("side", F.lit(0)).withColumn("mine", F.lit(True)))
    right = (placed.withColumn("cell", F.explode("visits")).join(small, "cell").withColumn("bv", block("nv", 2))
             .withColumn("bm", up_to("nm")).withColumn("side", F.lit(1)).withColumn("mine", F.col("own") == F.col("cell")))
    keys = ["cell", "bm", "bv"]
    cols = [*keys, "side", "rep", "copies", "mine", "vec"]
    ordered = (left.select(cols).unionByName(right.select(cols)).repartition(*keys)
               .sortWithinPartitions(*keys, "side", "rep"))

    def kernel(batches):
        for t, group in runs(batches, keys):
            ids, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
            side, mine = t["side"].to_numpy(), t["mine"].to_numpy(zero_copy_only=False)
            vec = t["vec"].combine_chunks()
            vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
            out = []
            for lo, hi in _bounds(group):
                x = _matrix(vec.slice(lo, hi - lo))
                m = int((side[lo:hi] == 0).sum())
                if not 0 < m < hi - lo:
                    continue
                unit = _Unit(ids[lo: lo + m], copies[lo: lo + m], x[:m])
                for a in range(m, hi - lo, VISITORS):
                    z = min(a + VISITORS, hi - lo)
                    out.append(unit.visit(ids[lo + a: lo + z], copies[lo + a: lo + z], x[a:z], mine[lo + a: lo + z],
                                          threshold))
                out.append(unit.result())
            if out:
                yield pa.record_batch([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(3)],
                                      names=["id", "links", "mate"])

    return map_arrow(ordered, kernel, "id long, links long, mate long")


def _bounds(group: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(group)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True)) if len(group) else []


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999,
                    cells_a_side: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, grouped = classes(vectors)
    reps = written(grouped, "imi-classes")
    placed = written(_placed(reps, build(reps, threshold, recall, cells_a_side)), "imi-cells")
    found = written(verified(placed, threshold), "imi-links")
    roots = components(found, "id", "mate", "imi")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = written(
        reps.select("rep", "h1", "h2", "copies").join(links, F.col("rep") == F.col("id"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                F.coalesce("root", "rep").alias("root")), "imi-named")
    out = rows.join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.coalesce(F.when(F.col("root") < NO_ID, F.col("root")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
