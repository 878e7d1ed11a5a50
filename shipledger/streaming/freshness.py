"""Keeping the processed table fresh.

The original rebuilds when any input export is newer than the output. Here
the inputs are described by path, length and modification time, taken without
reading their contents; the dataset is stale when they differ in either
direction from those of the published version (a file added, changed or
removed). A stale dataset is rebuilt incrementally and published whole: until
then, and if the rebuild fails, readers keep the version before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shipledger.plans.incremental import is_current, rebuild
from shipledger.sources.versions import current, drop_old

MANIFEST_COLS = ["path", "length", "modificationTime"]


def input_manifest(spark: SparkSession, source_dir: str, glob: str = "*.csv") -> DataFrame:
    """(path, length, modificationTime) of every export; contents not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(source_dir)
        .select(*MANIFEST_COLS)
    )


def is_stale(spark: SparkSession, source_dir: str, out_dir: str) -> bool:
    """True when nothing is published or the inputs differ from it."""
    return not is_current(spark, source_dir, out_dir)


def ensure_processed(spark: SparkSession, source_dir: str, out_dir: str, keep: int = 2) -> list[str]:
    """Rebuild the dataset under ``out_dir`` (table, cube, log) from
    ``source_dir`` when it is missing or stale, and drop versions older than the
    last ``keep``. Returns the steps taken."""
    if not is_stale(spark, source_dir, out_dir):
        return []
    made = rebuild(spark, source_dir, out_dir)
    if made is None:
        return []
    drop_old(spark, out_dir, keep)
    return ["rebuilt: processed dataset was missing or older than its inputs"]


def open_processed(spark: SparkSession, out_dir: str) -> DataFrame:
    """The published table."""
    found = current(spark, out_dir)
    if found is None:
        raise FileNotFoundError(f"nothing has been published under {out_dir}")
    return found.table(spark)
