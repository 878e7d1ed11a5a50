"""Session helpers: building a session for tests and tools, locating the shared
stage folder, and the two physical decisions the library makes by hand —
where to cut lineage, and when a side is small enough to broadcast."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size above which a derived lookup is joined by shuffle rather than broadcast.
BROADCAST_MAX_BYTES = 16 << 20
# Size of a shuffle partition up to which its side of a join is kept in a hash table.
HASHED_MAX_BYTES = 32 << 20

# Settings the library recommends for a cluster session too (README).
SESSION_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# For the library's own writes: what a write shuffled is deleted when it ends, and does not
# stay until the driver collects its garbage (a written frame is planned anew if used again).
WRITE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Written stages and stored tables: about three quarters of the size with the default codec.
STORED = {"compression": "zstd"}


def get_spark(master: str | None = None, partitions: int = 8, app: str = "shipledger") -> SparkSession:
    """A session configured the way the library expects. Used by tests, the
    bench and tools; on a cluster the caller's own session is used as is."""
    builder = (
        SparkSession.builder.master(master or "local[*]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHIPLEDGER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM never JIT-compiles a method above 8,000 bytes of bytecode.
        # The cleaning stage (adapter joins, ~30 row-level expressions) can
        # generate a longer fused loop, which would then run interpreted;
        # at this limit Spark falls back to per-operator generated code
        # (compiled) for such a stage instead. See SESSION_CONF.
        .config("spark.sql.codegen.hugeMethodLimit", SESSION_CONF["spark.sql.codegen.hugeMethodLimit"])
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder for materialised stages: the session's checkpoint
    directory. Only in local mode, with none configured, is a private temporary
    folder created and registered; on a cluster each executor would write to
    a disk of its own, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="shipledger-ckpt-")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


@contextmanager
def jit_sized(spark: SparkSession, more: dict[str, str] | None = None):
    """``SESSION_CONF`` and ``WRITE_CONF`` (and ``more``) for the writes inside, in a session
    that does not set them: a fused loop too long for the JIT would run interpreted (README).
    The session's own values are put back."""
    conf = {**SESSION_CONF, **WRITE_CONF, **(more or {})}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plain_options(df: DataFrame, columns) -> dict[str, str]:
    """Parquet options that store ``columns`` (where ``df`` has them; of a struct, its
    fields) without a dictionary: one of values that hardly repeat takes time to
    make and is given up or large."""
    leaves = []
    for f in df.schema.fields:
        if f.name in columns:
            leaves += [f"{f.name}.{x.name}" for x in f.dataType.fields] if f.dataType.typeName() == "struct" else [f.name]
    return {f"parquet.enable.dictionary#{leaf}": "false" for leaf in leaves}


def materialize(df: DataFrame, name: str, mode: str = "write", stages: list[str] | None = None,
                conf: dict[str, str] | None = None, plain=(), stored: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage at an expensive, multiply-consumed stage.

    ``write`` stores the stage as Parquet in the shared stage folder and reads
    it back, so later consumers get column pruning and filter pushdown and a
    lost executor costs a re-read, not a recompute of the shuffle above; the
    path is added to ``stages``, for ``drop_stages``. ``conf`` holds for the write;
    columns in ``plain`` get no dictionary (``plain_options``); ``stored`` replaces ``STORED``.
    ``checkpoint`` uses a reliable RDD checkpoint in the same folder.
    ``persist`` keeps it in memory/disk (lineage kept; for interactive use).
    """
    spark = df.sparkSession
    if mode == "persist":
        return df.persist()
    if mode == "checkpoint":
        stage_root(spark)
        return df.checkpoint(eager=True)
    if mode != "write":
        raise ValueError(f"unknown materialize mode {mode!r}")
    path = f"{stage_root(spark)}/stages/{name}-{uuid.uuid4().hex}"
    with jit_sized(spark, conf):
        df.write.mode("overwrite").options(**(STORED if stored is None else stored), **plain_options(df, plain)).parquet(path)
    if stages is not None:
        stages.append(path)
    return spark.read.parquet(path)


def drop_stages(spark: SparkSession, stages: list[str]) -> None:
    """Delete written stages; frames that read them must not be used again."""
    for path in stages:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    stages.clear()


def ensure_parallel(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has cores
    (a few large files, one row group each, a gzip CSV) over the default
    parallelism. A no-op for any input split wider than that, which is every
    large input, so no shuffle is added at scale. ``key`` should be a unique
    row column (e.g. the scan position): hashing it spreads evenly and is
    deterministic on retry without the sort a round-robin spread needs."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want, key) if key else df.repartition(want)
    return df


def text_bytes(df: DataFrame):
    """Column expression: bytes a row takes, roughly (16 a fixed-width column)."""
    size = F.lit(0)
    for f in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(16))
    return size


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only after checking its size in bytes; beyond the bound
    it is returned unchanged and the join shuffles. ``df`` must be cheap to
    read (a materialised stage, or a small aggregate over one)."""
    size = df.agg(F.coalesce(F.sum(text_bytes(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


def broadcasts(size: int) -> bool:
    """Whether a side of ``size`` bytes is broadcast."""
    return size <= BROADCAST_MAX_BYTES


def sized_side(df: DataFrame, size: int) -> DataFrame:
    """``df``, the smaller side of a join and ``size`` bytes large, with distinct keys:
    broadcast if small, hashed by partition if its partitions are (the other
    side is then not sorted), else left to the sort-merge join, which spills."""
    if broadcasts(size):
        return F.broadcast(df)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if size <= HASHED_MAX_BYTES * partitions else df
