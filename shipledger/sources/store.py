"""Sinks and typed re-reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shipledger.schema import SHIPMENT_COLUMNS, SHIPMENT_SCHEMA
from shipledger.session import STORED, drop_stages, jit_sized

# Tasks of a write that reads stored files: a CSV part is compressed by one task.
READ_CONF = {"spark.sql.files.maxPartitionBytes": "32m"}
# Rows of a part of a table that is written in parts: what is shuffled at once is bounded by it.
PART_ROWS = 30_000_000
# Types whose values a partition folder's name gives back as they were (an empty text is stored as null).
FOLDER_TYPES = ("date", "byte", "short", "integer", "long")


def sorted_table(table: DataFrame, partition_by: str | None = "ship_month") -> DataFrame:
    """The stable total order (ship_date, order_id). A global ``orderBy``
    is a range-partitioned shuffle: its sampled boundaries split a hot date by
    order id, so no task receives a whole hot key. The partition column leads
    the order, so a month-partitioned write needs no sort of its own."""
    lead = [partition_by] if partition_by and partition_by not in ("ship_date", "order_id") else []
    return table.orderBy(*lead, "ship_date", "order_id")


def partition_parts(sizes: dict, part_rows: int) -> list:
    """Where parts of ``part_rows`` rows at most begin, from the rows of each partition value in
    order (a value of more rows is a part of its own). The first begins before every value."""
    starts, held = [None], 0
    for value in sorted(v for v in sizes if v is not None):
        if held and held + sizes[value] > part_rows:
            starts.append(value)
            held = 0
        held += sizes[value]
    return starts


def _part(name: str, start, end) -> Column:
    """Rows of the part from ``start`` up to ``end``; a null value is in the first. The parts
    hold every row once, whatever their bounds."""
    inside = F.lit(True) if end is None else F.col(name) < end
    return F.coalesce(inside, F.lit(True)) if start is None else inside & (F.col(name) >= start)


def write_processed(table: DataFrame, path: str, csv_path: str | None = None,
                    partition_by: str | None = "ship_month", mode: str = "overwrite",
                    sort: bool = False, file_rows: int = 10_000_000, counts: list[Column] | None = None,
                    sizes: dict | None = None, part_rows: int = PART_ROWS) -> dict:
    """The processed table as Parquet, partitioned by month so date-range
    views prune whole directories; optionally the same rows as gzip CSV (a
    null and an empty text are told apart: empty is written as ""). Extra
    columns of the sources are kept.

    Rows are first dealt by month (``REBALANCE``), so a month has a few files
    and not one a task. The number of tasks follows the size: adaptive execution
    joins small months and splits a month that is larger than
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` (with one whose hash falls
    into the same partition, if any); no file has more than
    ``file_rows`` rows. Each file is in date order, so the days of a file are a
    narrow range in its statistics. ``sort`` writes in the W1 order instead.

    The CSV is written from the stored Parquet, where that holds these rows and no others: the
    rows are dealt and sorted once, not for each format.

    ``counts``: aggregates observed by the tasks that write the Parquet, and
    returned; they may use helper columns (``_``), which are not written.

    ``sizes``: the rows of each month, if the caller has them. A table of more than
    ``part_rows`` rows that is overwritten is then written in parts of whole months, and
    what one part shuffles is deleted before the next, so the disk that the deal takes
    does not grow with the table. ``counts`` are added up over the parts. A failure
    between two parts leaves no part behind."""
    spark = table.sparkSession
    starts = [None]
    if sizes and mode == "overwrite" and partition_by and not sort and spark.conf.get(
            "spark.sql.sources.partitionOverwriteMode", "static").lower() == "static":
        starts = partition_parts(sizes, part_rows)
    helpers = [c for c in table.columns if c.startswith("_")] if counts else []
    source, found = table, {}
    try:
        for k, (start, end) in enumerate(zip(starts, [*starts[1:], None], strict=True)):
            table = source.filter(_part(partition_by, start, end)) if len(starts) > 1 else source
            if sort:
                table = sorted_table(table, partition_by)
            elif partition_by:
                days = ["ship_date"] if "ship_date" in table.columns else []
                table = table.hint("rebalance", F.col(partition_by)).sortWithinPartitions(partition_by, *days)
            seen = Observation()
            out = table.observe(seen, *counts).drop(*helpers) if counts else table
            w = out.write.mode("append" if k else mode).options(**STORED).option("maxRecordsPerFile", file_rows)
            with jit_sized(spark):
                (w.partitionBy(partition_by) if partition_by else w).parquet(path)
            for name, n in seen.get.items() if counts else ():
                found[name] = found.get(name, 0) + n
    except BaseException:
        if len(starts) > 1:
            drop_stages(spark, [path])
        raise
    if csv_path:
        rows = (source if len(starts) > 1 else table).drop(*helpers)
        if mode == "overwrite" and partition_by and not sort and rows.schema[partition_by].dataType.typeName() in FOLDER_TYPES:
            rows = spark.read.schema(rows.schema).parquet(path).select(*[F.col(f"`{c}`") for c in rows.columns])
        with jit_sized(spark, READ_CONF):
            (rows.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
             .option("compression", "gzip").csv(csv_path))
    return found


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read back with the pinned types (no inference) in column order,
    then extra columns as they are (strings, from CSV)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        df = (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
              .option("emptyValue", "").csv(path))
    else:
        raise ValueError(fmt)
    extras = [c for c in df.columns if c not in SHIPMENT_COLUMNS]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SHIPMENT_SCHEMA.fields], *extras)


def _comparable(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = [*SHIPMENT_COLUMNS, *sorted((set(a.columns) | set(b.columns)) - set(SHIPMENT_COLUMNS))]
    return a.select(*cols), b.select(*cols)  # an extra column in one of them only is an error


def fingerprint(df: DataFrame, by: str | None = "ship_month") -> DataFrame:
    """An order-free fingerprint of a multiset of rows, per ``by``: the count,
    and the sum and exclusive-or of two 64-bit hashes of each row. It is combined
    map-side, so what is shuffled is one row a group and task, never a row."""
    whole = [F.col(f"`{c}`") for c in df.columns]
    one, two = F.xxhash64(*whole), F.xxhash64(F.lit("second"), *whole)
    wide = "decimal(20,0)"
    return df.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(one.cast(wide)).alias("sum_1"), F.bit_xor(one).alias("xor_1"),
        F.sum(two.cast(wide)).alias("sum_2"), F.bit_xor(two).alias("xor_2"))


def differing_groups(a: DataFrame, b: DataFrame, by: str = "ship_month") -> DataFrame:
    """The groups of ``by`` whose rows are not the same multiset in both."""
    a, b = _comparable(a, b)
    marks = ["rows", "sum_1", "xor_1", "sum_2", "xor_2"]
    left = fingerprint(a, by).select(F.col(by).alias("_a"), F.struct(*marks).alias("_fa"))
    right = fingerprint(b, by).select(F.col(by).alias("_b"), F.struct(*marks).alias("_fb"))
    both = left.join(right, F.col("_a").eqNullSafe(F.col("_b")), "full")
    return both.filter(~F.col("_fa").eqNullSafe(F.col("_fb"))).select(F.coalesce("_a", "_b").alias(by))


def parity(a: DataFrame, b: DataFrame, by: str = "ship_month") -> DataFrame:
    """Rows present in one frame and not the other, both ways (multiset);
    an empty result means the two storage formats hold the same table. Groups of
    ``by`` are compared by fingerprint; rows are shuffled and compared only
    for groups that differ (there are as many as months)."""
    a, b = _comparable(a, b)
    groups = [r[0] for r in differing_groups(a, b, by).collect()]
    if not groups:
        return a.limit(0).withColumn("_side", F.lit("left_only"))
    inside = F.col(by).isin([g for g in groups if g is not None])
    if None in groups:
        inside = F.coalesce(inside, F.lit(False)) | F.col(by).isNull()
    a, b = a.filter(inside), b.filter(inside)
    return a.exceptAll(b).withColumn("_side", F.lit("left_only")).unionByName(
        b.exceptAll(a).withColumn("_side", F.lit("right_only")))


def write_log(log: DataFrame, totals: DataFrame, path: str) -> None:
    """The cleaning log (one JSON object per step) and its totals."""
    log.coalesce(1).orderBy("seq").write.mode("overwrite").json(f"{path}/steps")
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals")


def export_evidence(evidence: DataFrame, path: str) -> None:
    """Evidence tables as CSV, one folder per finding."""
    evidence.write.mode("overwrite").option("header", True).partitionBy("key").csv(path)
