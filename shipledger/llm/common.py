"""Helpers shared by the operators: shipping the package to the executors,
written stages, and Arrow kernels over whole texts in bounded slices."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.session import materialize

# Text handled at once inside a task; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers (once per application),
    so that kernels are sent by name and worker caches outlive a task."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="pkg-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back. Once nothing
    refers to the plan that made it, Spark's context cleaner may drop that
    plan's shuffle files; the collection here lets it do so now."""
    out = materialize(df, name, stored={})
    spark = df.sparkSession
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(kernel, schema)


def keep_rows(df: DataFrame, mask: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """Rows of ``df``, with all their columns, whose texts ``mask`` keeps.
    Columns travel by number: Arrow functions take no name with a dot in it."""
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    text = f"c{df.columns.index('text')}"

    def kernel(batches):
        for b in batches:
            yield b.filter(mask(strings(b.column(text))))

    return map_arrow(numbered, kernel, numbered.schema).toDF(*df.columns)


def strings(column: pa.Array) -> pa.Array:
    """A text column without nulls (null counts as the empty text)."""
    if pa.types.is_null(column.type):
        return pa.array([""] * len(column), pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``most`` bytes (or one row)."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, flat and in order.

    ``flat``: the words; ``n``: words per text; ``start``: index of each
    text's first word; ``doc``: the text that each word belongs to.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        doc = np.repeat(np.arange(len(texts)), sizes)
        if not full.all():
            flat, doc = flat.filter(pa.array(full)), doc[full]
        self.flat, self.doc = flat, doc
        self.n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        self.start = np.cumsum(self.n) - self.n
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary

    def windows(self, size: int) -> np.ndarray:
        """Starts (flat indices) of all windows of ``size`` words of one text."""
        if len(self.doc) < size:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - size + 1] == self.doc[size - 1:])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def polynomial(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values (unsigned 64 bits)."""
    m = len(values) - size + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j, r in enumerate(multipliers(size, seed)):
        out += values[j: j + m] * r
    return mix(out)


def fold(column: str, buckets: int) -> F.Column:
    """Remainder of the CRC-32 of an id as decimal text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(buckets))


def labelled_ids(labels: DataFrame, label: str, fold_n: int, held: int, most: int) -> DataFrame:
    """At most ``most`` training ids of each class, by hash order, outside the
    held-out fold: (doc_id, y), each id once. Ids labelled both ways are left
    out before anything is counted."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)))
    if fold_n:
        rows = rows.where(fold("doc_id", fold_n) != held)
    key = F.xxhash64("doc_id")
    each = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_m")).where("y = _m").drop("_m")
    parts = [each.where(F.col("y") == y).orderBy(key, "doc_id").limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def join_small(df: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, y and text of the documents in ``ids``, a frame bounded by a sample
    size parameter (hence the broadcast). An id that repeats gives one row, with
    its smallest text, so the bound holds for rows too."""
    rows = df.join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
