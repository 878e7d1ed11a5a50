"""SimHash near-dedup (operator 10): segment-popcount embedding.

1. Each whole text gets a 64-bit SimHash of its word shingles.
2. Equal fingerprints are one class (grouped with map-side combining), so
   copies are never compared with one another.
3. A fingerprint is embedded as the bit counts of its 32 two-bit segments. The
   Manhattan distance of two embeddings is at most their bit distance. The
   segments form ``distance + match`` blocks; if the distance is within the
   limit, the embeddings agree in at least ``match`` whole blocks, so each
   fingerprint goes to one grid cell for every choice of ``match`` blocks, and
   every pair within the limit meets in a cell.
4. Inside a cell, pairs whose total bit counts, and then embeddings, are
   further apart than the limit are put aside; the others are verified on the
   fingerprints. Only edges that join two groups are put out, so a cell of m
   members gives at most m - 1 rows. A cell with more than ``BLOCK`` members is
   cut into blocks by hash, and each pair of blocks is a unit of its own, so no
   task holds an unbounded group; no pair is lost.
5. Connected components by star contraction; the component's id is the
   smallest doc_id.
6. ``keep_one`` decides row by row: the survivor of a component is its smallest
   (doc_id, fingerprint as a long, hash of the text, hash of the row), a null
   doc_id after all others, and only that row stays.

For far more distinct fingerprints raise ``match``: 3 gives 35 cells a
fingerprint but about thirty times fewer pairs to test.

Defined cases: a null or empty text, or one of white space, has no word and
fingerprint zero, linked like any other; fewer words than a shingle: one
shingle of all words; in ``groups`` repeated rows each keep their row, and a null
doc_id keeps its row and gets its component's smallest id (null if there is
none); an empty table gives an empty result; only the id and the text are read.
``keep_one`` reads all columns and returns them untouched: of repeated rows, of
rows that share an id, and of rows without an id, one of each component stays.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import map_arrow, strings, written
from shipledger.llm.graph import components
from shipledger.llm.streams import runs

SEGMENTS, BLOCK = 32, 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EVEN = 0x5555555555555555


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash over XXH64 (seed 42) of the word shingles, repeats included: a
    bit is 1 if it is set in over half of the hashes."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[size - 1:].tolist()
    total, n = np.zeros(64, np.int64), len(ends)
    digest, starts = xxhash.xxh64_intdigest, starts.tolist()
    for lo in range(0, n, 65536):
        part = range(lo, min(n, lo + 65536))
        h = np.array([digest(joined[starts[i]: ends[i]], 42) for i in part], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of each document, and the
    long columns ``also``."""
    def kernel(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in strings(b.column("text")).to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fps.view(np.int64)),
                                   **{c: b.column(c) for c in also}})

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also), kernel,
                     ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


def embedding(fp):
    """The bit counts (0, 1, 2) of all two-bit segments, in place of their bits."""
    high = F.shiftrightunsigned(fp, 1)
    even = F.lit(_EVEN)
    return high.bitwiseXOR(fp).bitwiseAND(even).bitwiseOR(F.shiftleft(high.bitwiseAND(fp).bitwiseAND(even), 1))


def _masks(distance: int, match: int) -> list[int]:
    """For each choice of ``match`` blocks, the mask of their segments."""
    n = distance + match
    if n > SEGMENTS:
        raise ValueError(f"a distance of {distance} needs more than {SEGMENTS} segments")
    cuts = [SEGMENTS * k // n for k in range(n + 1)]
    block = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(block[k] for k in chosen)) for chosen in combinations(range(n), match)]


def _segment_counts(fp: np.ndarray) -> np.ndarray:
    high, even = fp >> np.uint64(1), np.uint64(_EVEN)
    packed = ((high ^ fp) & even) | ((high & fp & even) << np.uint64(1))
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return ((packed[:, None] >> shifts) & np.uint64(3)).astype(np.int8)


def cell_links(fp: np.ndarray, side: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links inside each group (rows sorted by group).
    Where a group has rows of two sides, only pairs across them are tested."""
    n = len(fp)
    parent = np.arange(n)
    bits = np.bitwise_count(fp).astype(np.int16)
    size = np.bincount(group)
    first = np.cumsum(size) - size
    two = side[first[group]] != np.maximum.reduceat(side, first)[group] if n else np.zeros(0, bool)
    mixed = two | (np.minimum.reduceat(side, first)[group] != np.maximum.reduceat(side, first)[group]) if n else two
    active = np.flatnonzero(size[group] > 1)
    out_a, out_b, k = [], [], 0
    while True:
        k += 1
        active = active[active + k < n]
        active = active[group[active + k] == group[active]]
        if not len(active):
            break
        a, b = active, active + k
        near = (np.abs(bits[a] - bits[b]) <= distance) & ~(mixed[a] & (side[a] == side[b]))
        a, b = a[near], b[near]
        if len(a):
            close = np.abs(_segment_counts(fp[a]) - _segment_counts(fp[b])).sum(1) <= distance
            a, b = a[close], b[close]
            exact = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            a, b = a[exact], b[exact]
            apart = parent[a] != parent[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                rx, ry = x, y
                while parent[rx] != rx:
                    rx = parent[rx]
                while parent[ry] != ry:
                    ry = parent[ry]
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    out_a.append(x)
                    out_b.append(y)
            while len(a) and (parent[parent] != parent).any():
                parent = parent[parent]
    return fp[np.array(out_a, np.int64)], fp[np.array(out_b, np.int64)]


def links(classes: DataFrame, distance: int = 4, match: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``distance`` bits that
    connect all that are linked."""
    masks = _masks(distance, match)
    fp = F.col("fp")
    cells = classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), embedding(fp).bitwiseAND(F.lit(m)).alias("cell")) for t, m in enumerate(masks)
    ])).alias("c")).select("fp", "c.t", "c.cell")
    full = written(cells.groupBy("t", "cell").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
                   .select("t", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("n")), "simhash-full")
    n = F.coalesce(F.col("n"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    units = cells.join(full, ["t", "cell"], "left").withColumn("side", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "t", "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fp")
    keys = ["t", "cell", "i", "j"]
    ordered = units.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def kernel(batches):
        for t, group in runs(batches, keys):
            a, b = cell_links(t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy(), group, distance)
            yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return map_arrow(ordered, kernel, "a long, b long")


def _linked(fps: DataFrame, distance: int, match: int) -> tuple[DataFrame, DataFrame]:
    """The classes (fp, first_id), and fp, root, first_id of those that are linked."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(links(classes, distance, match), "a", "b", "simhash")
    linked = written(classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first_id"), "simhash-linked")
    return classes, linked


def groups(docs: DataFrame, shingle: int = 4, distance: int = 4, match: int = 2) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    fps = written(fingerprints(docs, shingle), "simhash-fp")
    classes, linked = _linked(fps, distance, match)
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    ids = written(classes.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-ids")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with numbered columns (their names may be any), then doc_id,
    text, the text's hash and the row's: 128 bits tell different texts apart."""
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = dict(zip(docs.columns, rows.columns, strict=True))
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]  # Spark hashes no others
    return rows.select("*", F.col(at["doc_id"]).cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("text_hash"),
                       F.xxhash64(*[x for c in hashed for x in (F.col(c), F.col(c).isNull())]).alias("row_hash"))


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, match: int = 2) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id (null:
    after all others), then fingerprint, text hash and row hash. Of rows equal
    in all of these any one stays; they are dropped before rows meet, so many
    copies of a row are never one group."""
    rows, hashes = _keyed(docs), ("text_hash", "row_hash")
    fps = written(fingerprints(rows, shingle, hashes), "simhash-fp")
    _, linked = _linked(fps, distance, match)
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", *hashes)).alias("r"))
    kept = written(first.join(linked.select("fp", "root"), "fp", "left")
                   .groupBy(F.coalesce("root", "fp").alias("root"))
                   .agg(F.min(F.struct("r.lost", "r.doc_id", "fp", "r.text_hash", "r.row_hash")).alias("r"))
                   .select(F.coalesce("r.doc_id", F.lit(0)).alias("id"), *[f"r.{h}" for h in hashes]), "simhash-kept")
    key = ["id", *hashes]  # no id counts as 0 here: the row's hash knows which it is
    numbered = [c for c in rows.columns if c not in ("doc_id", "text", *hashes)]
    single = rows.select(*numbered, F.coalesce("doc_id", F.lit(0)).alias("id"), *hashes).dropDuplicates(key)
    return single.join(kept, key, "left_semi").select(*numbered).toDF(*docs.columns)
