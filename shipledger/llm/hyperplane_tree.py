"""Hard-negative mining (operator 12): multiway hyperplane tree (GNAT).

Vectors are scaled to integers; a score is their integer inner product, exact.
An anchor's positives are its best rows of the same label; for each positive
its hard negatives are the best rows of another label whose score lies in a
window below the positive's.

1. Scores become distances: with one more coordinate every row lies on a
   sphere of the largest norm, where distance falls as the score rises, so a
   score window is an annulus around the anchor.
2. A tree is grown on a bounded sample (``SAMPLE`` rows by hash order): each
   node has up to ``WAYS`` split points chosen far apart, and a row goes to
   the nearest one's subtree. Every row is then indexed, and every node gets,
   over all rows, the range of distances from each split point to each sibling
   subtree (one map-side-combined aggregation).
3. A search walks all nodes whose rows may lie in its annulus: a subtree is
   left out if, for some split point, the distances that the annulus allows
   by the triangle inequality do not meet the subtree's range. Leaves are
   scored exactly, as matrix products. So nothing is missed: the tree only
   leaves out what cannot count (``SLACK`` covers rounding).
4. Three searches: an anchor's own block gives a bound for its positives; all
   leaves within that bound give the positives; all leaves that meet one of
   the windows give the negatives. Blocks return their first few rows, and
   a limited row number over them gives the first few of all.

Leaves of more than ``UNIT`` rows (copies cannot be told apart by hyperplanes)
are dealt to blocks by the hash of the id, so no task holds an unbounded
group; anchors that visit a block are streamed past it. What the driver sees is
the sample, the tree's ranges and a count a leaf: at most ``LEAVES`` leaves.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component take no part; an id that repeats stands for its smallest (label,
vector); shorter vectors are filled up with zeros, so an empty vector scores
0; ties go to the smaller id; a window below a negative positive score is
empty; anchors without a positive or a negative give no row; an empty table
gives an empty result; columns other than the four named are not read. A
component of 2**26 or more after scaling is an error (scores would overflow).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipledger.llm.common import map_arrow, written

SAMPLE, WAYS, LEAVES = 8192, 16, 1024
LEAF, UNIT = 1024, 4096  # rows aimed at in a leaf; most rows of a block
CELLS = 1 << 21  # scores held at once
SLACK = 1e-6
LIMIT = 1 << 26


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    (ah, al), (bh, bl) = ((x >> 13, x & 0x1FFF) for x in (a.astype(np.int64), b.astype(np.int64)))
    f = lambda x, y: (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return (f(ah, bh) << 26) + ((f(ah, bl) + f(al, bh)) << 13) + f(al, bl)


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, anchor and v (four bytes a component) of the rows that
    take part, one row an id."""
    def kernel(batches):
        for b in batches:
            e = b.column("embedding")
            n = pc.fill_null(pc.list_value_length(e), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.cast(e.flatten(), pa.float64())
            x = np.floor(scale * pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False))
            end = np.cumsum(n)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            fine = (bad[end] == bad[end - n]) & pc.is_valid(e).to_numpy(zero_copy_only=False)
            usable = np.repeat(fine, n)
            if (np.abs(x[usable]) >= LIMIT).any():
                raise ValueError(f"a component is {LIMIT} or more after scaling")
            raw = memoryview(np.where(usable, x, 0).astype("<i4")).cast("B")
            v = pa.array([bytes(raw[4 * (k - m): 4 * k]) for k, m in zip(end.tolist(), n.tolist(), strict=True)], pa.binary())
            out = pa.record_batch({"vec_id": b.column("vec_id"), "label": b.column("label"),
                                   "anchor": b.column("anchor"), "v": v})
            yield out.filter(pa.array(fine))

    named = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding"),
                        F.coalesce("anchor", F.lit(False)).alias("anchor"))
    ints = map_arrow(named.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"), kernel,
                     "vec_id long, label long, anchor boolean, v binary")
    return ints.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select(
        "vec_id", "r.label", "r.anchor", "r.v")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for k, raw in enumerate(column.to_pylist()):
        out[k, : len(raw) // 4] = np.frombuffer(raw, "<i4")
    return out


class Tree:
    """Split points (on the sphere), children, and, once ``ranges`` is set,
    the distance ranges between split points and sibling subtrees."""

    def __init__(self, x: np.ndarray, norm2: float, rows: int):
        self.dim, self.norm2 = x.shape[1], norm2
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []  # node number, or -1 - leaf
        self.leaves = 0
        aim = max(LEAF * len(x) / max(rows, 1), len(x) / LEAVES * 2, 4)
        self.root = self._grow(self.lifted(x), aim, np.random.default_rng(7))
        self.low = self.high = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.norm2 - (x**2).sum(1), 0))[:, None]])

    def _grow(self, y: np.ndarray, aim: float, rng) -> int:
        ways = min(WAYS, math.ceil(len(y) / aim))
        pick = self._far_apart(y, ways, rng) if ways > 1 else []
        if len(pick) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(y[pick])
        self.children.append([])
        near = distance(y, self.points[node]).argmin(1)
        self.children[node] = [self._grow(y[near == j], aim, rng) for j in range(len(pick))]
        return node

    @staticmethod
    def _far_apart(y: np.ndarray, ways: int, rng) -> list[int]:
        """Rows of a random few, each the farthest from those picked before."""
        few = rng.choice(len(y), min(len(y), 6 * ways), replace=False)
        d = distance(y[few], y[few])
        picked = [0]
        while len(picked) < ways:
            gap = d[:, picked].min(1)
            k = int(gap.argmax())
            if gap[k] <= 1e-3:
                break
            picked.append(k)
        return few[picked].tolist()

    def place(self, x: np.ndarray):
        """Leaf of each row, and what the rows say of the ranges: (node,
        split point, subtree, least, greatest distance)."""
        leaf, seen = np.zeros(len(x), np.int64), []
        y, todo = self.lifted(x), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -1 - node
                continue
            d = distance(y[rows], self.points[node])
            near = d.argmin(1)
            for j, child in enumerate(self.children[node]):
                mine = near == j
                if mine.any():
                    seen += [(node, i, j, lo, hi) for i, (lo, hi) in enumerate(
                        zip(d[mine].min(0).tolist(), d[mine].max(0).tolist(), strict=True))]
                    todo.append((child, rows[mine]))
        return leaf, seen

    def set_ranges(self, rows) -> None:
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        for node, i, j, lo, hi in rows:
            self.low[node][i, j], self.high[node][i, j] = lo, hi

    def search(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves that may hold a row at a distance in one
        of the query's annuli near[k] to far[k] (arrays of queries x annuli)."""
        y = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        slack = SLACK * math.sqrt(self.norm2 + 1) + SLACK * np.sqrt((y**2).sum(1))
        which, leaf, todo = [], [], [(self.root, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                which.append(rows)
                leaf.append(np.full(len(rows), -1 - node))
                continue
            d = distance(y[rows], self.points[node])
            for j, child in enumerate(self.children[node]):
                lo, hi = self.low[node][:, j], self.high[node][:, j]
                least = np.maximum(lo - d, d - hi).max(1) - slack[rows]  # of the query to any row of the subtree
                most = (d + hi).min(1) + slack[rows]
                alive = ((least[:, None] <= far[rows]) & (most[:, None] >= near[rows])).any(1)
                if alive.any():
                    todo.append((child, rows[alive]))
        if not which:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(which), np.concatenate(leaf)

    def distances(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance from a query to a row of a given score; none below 0."""
        d2 = (q.astype(np.float64)**2).sum(1)[:, None] + self.norm2 - 2 * scores
        return np.sqrt(np.maximum(d2, 0))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0))


def index(rows: DataFrame) -> tuple[DataFrame, Tree, dict[int, int]]:
    """Rows with their leaf and block; the tree; blocks of each leaf. ``rows``
    is a written table."""
    got = _norms(rows).agg(F.max("norm2").alias("norm2"), F.max("dim").alias("dim"), F.count("*").alias("n")).first()
    dim, norm2, n = int(got["dim"] or 0), float(got["norm2"] or 0.0), got["n"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    tree = Tree(matrix(sample, dim), norm2, n)

    def kernel(batches):
        seen: dict[tuple[int, int, int], tuple[float, float]] = {}
        for b in batches:
            leaf, more = tree.place(matrix(b.column("v"), dim))
            for node, i, j, lo, hi in more:
                a, z = seen.get((node, i, j), (lo, hi))
                seen[node, i, j] = (min(a, lo), max(z, hi))
            empty = pa.nulls(b.num_rows, pa.float64())
            yield pa.record_batch({"leaf": pa.array(leaf), **{c: b.column(c) for c in ("vec_id", "label", "anchor", "v")},
                                   "i": pa.nulls(b.num_rows, pa.int64()), "j": pa.nulls(b.num_rows, pa.int64()),
                                   "low": empty, "high": empty})
        m = len(seen)
        keys = np.array(list(seen), np.int64).reshape(-1, 3)
        ends = np.array(list(seen.values()), np.float64).reshape(-1, 2)
        yield pa.record_batch({"leaf": pa.array(keys[:, 0]), "vec_id": pa.nulls(m, pa.int64()),
                               "label": pa.nulls(m, pa.int64()), "anchor": pa.nulls(m, pa.bool_()),
                               "v": pa.nulls(m, pa.binary()), "i": pa.array(keys[:, 1]), "j": pa.array(keys[:, 2]),
                               "low": pa.array(ends[:, 0]), "high": pa.array(ends[:, 1])})

    placed = written(map_arrow(rows.select("vec_id", "label", "anchor", "v"), kernel,
                               "leaf long, vec_id long, label long, anchor boolean, v binary, i long, j long, "
                               "low double, high double"), "tree-rows")
    ranges = (placed.where("i IS NOT NULL").groupBy(F.col("leaf").alias("node"), "i", "j")
              .agg(F.min("low"), F.max("high")).collect())  # at most LEAVES * WAYS rows of each split point
    tree.set_ranges([tuple(r) for r in ranges])
    inside = placed.where("i IS NULL").select("leaf", "vec_id", "label", "anchor", "v")
    blocks = {r["leaf"]: -(-r["n"] // UNIT) for r in inside.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    return inside, tree, blocks


def _norms(rows: DataFrame) -> DataFrame:
    def kernel(batches):
        for b in batches:
            x = [np.frombuffer(v, "<i4").astype(np.float64) for v in b.column("v").to_pylist()]
            yield pa.record_batch({"norm2": pa.array([float(v @ v) for v in x], pa.float64()),
                                   "dim": pa.array([len(v) for v in x], pa.int64())})

    return map_arrow(rows.select("v"), kernel, "norm2 double, dim long")


def _first(score: np.ndarray, ok: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``most`` columns of each row among ``ok``, by
    score, ties by column."""
    s = np.where(ok, score, np.iinfo(np.int64).min)
    if s.shape[1] > most:
        bar = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
        ok = ok & (s >= bar[:, None])
    r, c = np.nonzero(ok)
    order = np.lexsort((c, -s[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < most], c[place < most]


_FOUND = "anchor_id long, slot int, score long, vec_id long"


def _scan(units: DataFrame, visits: DataFrame, dim: int, pick) -> DataFrame:
    """Rows of each unit against the anchors that visit it. ``pick(score,
    labels, ids, batch)`` gives (row, column, slot) of what counts."""
    kind = F.lit(0)
    rows = units.select("leaf", "block", kind.alias("kind"), "vec_id", "label", "v",
                        F.lit(None).cast("array<long>").alias("bounds"))
    seekers = visits.select("leaf", "block", F.lit(1).alias("kind"), "vec_id", "label", "v", "bounds")
    # units are dealt with the visits they get; a unit's rows come first, in order of their ids
    together = rows.unionByName(seekers).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind", "vec_id")

    def kernel(batches):
        now, held, block = None, [], None
        for b in batches:
            key = [b.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "block", "kind")]
            turn = np.zeros(b.num_rows, bool)
            for k in key:
                turn[1:] |= k[1:] != k[:-1]
            cuts = np.flatnonzero(turn)
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if hi == lo:
                    continue
                part = pa.table(b.slice(lo, hi - lo))
                if (key[0][lo], key[1][lo]) != now:
                    now, held, block = (key[0][lo], key[1][lo]), [], None
                if key[2][lo] == 0:
                    held.append(part.select(["vec_id", "label", "v"]))
                    continue
                if block is None:
                    t = pa.concat_tables(held).combine_chunks() if held else None
                    block = () if t is None else (t["vec_id"].to_numpy(), t["label"].to_numpy(),
                                                  matrix(t["v"].combine_chunks(), dim))
                if not block:
                    continue
                ids, labels, x = block
                step = max(1, CELLS // len(ids))
                for at in range(0, part.num_rows, step):
                    seekers = part.slice(at, step).combine_chunks()
                    score = products(matrix(seekers["v"].combine_chunks(), dim), x)
                    r, c, slot = pick(score, labels, ids, seekers)
                    yield pa.record_batch({"anchor_id": pa.array(seekers["vec_id"].to_numpy()[r]),
                                           "slot": pa.array(slot.astype(np.int32)), "score": pa.array(score[r, c]),
                                           "vec_id": pa.array(ids[c])})

    return map_arrow(together, kernel, _FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each (anchor_id, slot), numbered."""
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _visits(anchors: DataFrame, tree: Tree, blocks: dict[int, int], annuli) -> DataFrame:
    """One row a block that an anchor has to see. ``annuli(q, bounds)`` gives
    the least and greatest distances of its windows."""
    def kernel(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                q = matrix(part.column("v"), tree.dim)
                near, far = annuli(q, part.column("bounds").to_pylist())
                which, leaf = tree.search(q, near, far)
                n = np.array([blocks.get(k, 0) for k in leaf.tolist()], np.int64)
                which, leaf = np.repeat(which, n), np.repeat(leaf, n)
                block = np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
                for at in range(0, max(len(leaf), 1), 4096):
                    some = part.take(pa.array(which[at: at + 4096]))
                    yield pa.record_batch({"leaf": pa.array(leaf[at: at + 4096]), "block": pa.array(block[at: at + 4096]),
                                           **{c: some.column(c) for c in ("vec_id", "label", "v", "bounds")}})

    return map_arrow(anchors.select("vec_id", "label", "v", "bounds"), kernel,
                     "leaf long, block long, vec_id long, label long, v binary, bounds array<long>")


def mine(rows: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100) -> DataFrame:
    """``rows``: vec_id, label, embedding, anchor (boolean). For each anchor and
    positive the first negatives with low * positive_score <= 100 *
    negative_score <= high * positive_score: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    table = written(scaled(rows, scale), "tree-input")
    inside, tree, blocks = index(table)
    dim = tree.dim
    per_leaf = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]) if blocks else F.create_map(F.lit(-1), F.lit(1))
    units = inside.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_leaf[F.col("leaf")]).cast("long"))
    anchors = inside.where("anchor").select("vec_id", "label", "v")

    def same(score, labels, ids, seekers):
        ok = (labels[None] == seekers["label"].to_numpy()[:, None]) & (ids[None] != seekers["vec_id"].to_numpy()[:, None])
        r, c = _first(score, ok, positives)
        return r, c, np.zeros(len(r), np.int32)

    own = units.where("anchor").withColumn("bounds", F.lit(None).cast("array<long>"))
    # the last of the positives in the anchor's own block: none of all rows' first ones scores less
    bar = _best(_scan(units, own, dim, same), positives).where(F.col("rank") == positives).select(
        F.col("anchor_id").alias("vec_id"), F.array("score").alias("bounds"))
    bounded = written(anchors.join(bar, "vec_id", "left"), "tree-bounded")

    def above(q, bounds):
        floor = np.array([[-np.inf if x is None else float(x[0])] for x in bounds]).reshape(-1, 1)
        return np.zeros((len(q), 1)), np.where(np.isfinite(floor), tree.distances(q, np.nan_to_num(floor, neginf=0.0)), np.inf)

    first = written(_best(_scan(units, _visits(bounded, tree, blocks, above), dim, same), positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.col("rank").cast("int").alias("slot")), "tree-positives")
    windows = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("slot", "positive_score")))["positive_score"].alias("bounds"))
    seeking = anchors.join(windows, "vec_id")

    def ends(bounds):
        """Least and greatest score of each window (the list is padded with
        empty ones), in whole numbers."""
        lo = np.array([[-(-low * s // 100) for s in x] + [1] * (positives - len(x)) for x in bounds], np.int64)
        hi = np.array([[high * s // 100 for s in x] + [0] * (positives - len(x)) for x in bounds], np.int64)
        return lo.reshape(-1, positives), hi.reshape(-1, positives)

    def annuli(q, bounds):
        lo, hi = ends(bounds)
        return (np.where(lo <= hi, tree.distances(q, hi), np.inf), np.where(lo <= hi, tree.distances(q, lo), -np.inf))

    def other(score, labels, ids, seekers):
        lo, hi = ends(seekers["bounds"].to_pylist())
        differs = labels[None] != seekers["label"].to_numpy()[:, None]
        got = []
        for k in range(positives):
            ok = differs & (score >= lo[:, k: k + 1]) & (score <= hi[:, k: k + 1])
            if ok.any():
                r, c = _first(score, ok, negatives)
                got.append((r, c, np.full(len(r), k + 1, np.int32)))
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    hard = _best(_scan(units, _visits(seeking, tree, blocks, annuli), dim, other), negatives)
    return hard.join(first, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
