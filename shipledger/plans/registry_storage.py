"""Registered queries for storage and rebuilding."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shipledger import constants as K
from shipledger.operators import findings as FD
from shipledger.plans import incremental
from shipledger.plans import oracle as O
from shipledger.plans import oracle_findings as OF
from shipledger.plans.build import processed
from shipledger.plans.registry import cnt, register
from shipledger.plans.registry_steps import _derived_cols_spark
from shipledger.schema import SHIPMENT_SCHEMA
from shipledger.session import jit_sized, stage_root
from shipledger.sources import ingest, store
from shipledger.sources import testbook
from shipledger.sources import versions as VS
from shipledger.sources.testbook import raw_shipments


# Line items of one export of ``rebuilt_incrementally``.
EXPORT_LINES = 1_000_000


def _sql(body: str) -> str:
    return O.with_ctes() + "\n" + body


def _folder(spark, name: str) -> str:
    return f"{stage_root(spark)}/stages/{name}-{uuid.uuid4().hex}"


# --- S12, C21 rebuilt from a changed set of exports -----------------------------------------

def _rebuilt_sql() -> str:
    cols = [f"CAST({f.name} AS DOUBLE) AS {f.name}" if f.dataType.typeName() == "decimal" else f.name
            for f in SHIPMENT_SCHEMA.fields if f.name != "source_file"]
    return _sql("SELECT " + ", ".join(cols) + " FROM shipments")


@register("rebuilt_incrementally", _rebuilt_sql)
def q_rebuilt(spark, sf_dir):
    """The raw export written as several CSVs in its order; a version built
    without a quarter of them, then brought up to date with all: the whole table.
    There are as many as cores, four at least, so no task gets a quarter of the rows, and one
    for each million line items, as an export is compressed and so read by one task. The
    narrow lines are dealt and sorted; the export's texts are made from them afterwards."""
    top = _folder(spark, "rebuilt")
    lines = testbook.shipment_lines(spark, sf_dir)
    exports = max(4, spark.sparkContext.defaultParallelism, -(-testbook.load(spark, sf_dir, "lineitem").count() // EXPORT_LINES))
    dealt = lines.repartitionByRange(exports, *testbook.FILE_ORDER).sortWithinPartitions(*testbook.FILE_ORDER)
    with jit_sized(spark):
        (testbook.export_columns(dealt).select(*K.REQUIRED_COLUMNS).write
         .option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).option("compression", "gzip").csv(f"{top}/exports"))
    paths = [f"{top}/exports/{name}" for name, _ in sorted(VS.Folder(spark, f"{top}/exports").names(""))
             if name.endswith(".csv.gz")]
    incremental.rebuild(spark, [p for k, p in enumerate(paths) if k % 4 != 1], f"{top}/out")
    version = incremental.rebuild(spark, paths, f"{top}/out")
    return version.table(spark).select(*[c for c, f in zip(_derived_cols_spark(), SHIPMENT_SCHEMA.fields, strict=True)
                                         if f.name != "source_file"])


# --- W1 the stable order of the written table -------------------------------------------------

@register("sorted_write", lambda: _sql(f"SELECT ship_month, {cnt()} AS rows, CAST(0 AS BIGINT) AS out_of_order "
                                       "FROM shipments GROUP BY ship_month"))
def q_sorted_write(spark, sf_dir):
    """Rows of each month of the table written in its stable order, and those
    that stand before a row of their file that they should follow."""
    path = _folder(spark, "sorted")
    store.write_processed(processed(spark, sf_dir).table, path, sort=True)
    back = spark.read.parquet(path)
    place = Window.partitionBy("_file").orderBy("_row")  # a file is bounded by its row count
    key = F.struct("ship_date", F.coalesce("order_id", F.lit("")))
    rows = back.select("ship_month", key.alias("_key"), F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.row_index").alias("_row"))
    return rows.withColumn("_next", F.lead("_key").over(place)).groupBy("ship_month").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_next") < F.col("_key")).alias("out_of_order"))


# --- S10 order-free parity of two formats -----------------------------------------------------

@register("parity_by_month", lambda: _sql(f"SELECT ship_month, {cnt()} AS rows, true AS same, false AS same_without_a_row "
                                          "FROM shipments GROUP BY ship_month"))
def q_parity(spark, sf_dir):
    """The table against its gzip CSV, by fingerprint; and against itself without
    the smallest order id of each month, which must differ."""
    path = _folder(spark, "parity")
    t = processed(spark, sf_dir).table
    sizes = {r["ship_month"]: r["count"] for r in t.groupBy("ship_month").count().collect()}  # as many as months
    store.write_processed(t, f"{path}/parquet", csv_path=f"{path}/csv", sizes=sizes)
    b = store.read_processed(spark, f"{path}/csv", "csv")
    one = t.groupBy("ship_month").agg(F.min("order_id").alias("order_id"))
    less = t.join(F.broadcast(one), ["ship_month", "order_id"], "left_anti")  # one row a month
    months = store.fingerprint(t).select("ship_month", "rows")
    for name, other in (("same", b), ("same_without_a_row", less)):
        found = store.differing_groups(t, other).select(F.col("ship_month").alias("_m"), F.lit(True).alias("_d"))
        months = months.join(found, F.col("ship_month").eqNullSafe(F.col("_m")), "left").withColumn(
            name, F.col("_d").isNull()).drop("_m", "_d")
    return months


# --- S13 evidence as files -----------------------------------------------------------------------

@register("evidence_exported", OF.evidence_sql)
def q_evidence_exported(spark, sf_dir):
    """The evidence tables written as CSV, one folder a finding, and read back."""
    path = _folder(spark, "evidence")
    ev = FD.evidence(processed(spark, sf_dir).table)
    store.export_evidence(ev, path)
    back = spark.read.option("header", True).option("basePath", path).csv(path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ev.schema.fields])


# --- S6 the required columns over the union of the exports ------------------------------------

def _required_sql() -> str:
    return _sql("SELECT unnest(" + O.arr(K.REQUIRED_COLUMNS) + ") AS required, rows_seen, true AS refused_without "
                "FROM (SELECT CAST(count(*) AS BIGINT) AS rows_seen FROM raw)")


@register("required_columns", _required_sql)
def q_required(spark, sf_dir):
    """Each required column: the rows that the exports have under some name for
    it, and whether the exports are refused when none of them has it."""
    raw = raw_shipments(spark, sf_dir)
    seen = raw.agg(*[F.count(F.lit(1)).alias(c) for c in K.REQUIRED_COLUMNS])
    refused = {}
    for c in K.REQUIRED_COLUMNS:
        try:
            ingest.reconcile_frames({"a.csv": raw.drop(c), "b.csv": raw.drop(c)})
            refused[c] = False
        except ValueError as e:
            refused[c] = c in str(e)
    return seen.select(F.inline(F.array(*[F.struct(F.lit(c).alias("required"), F.col(c).alias("rows_seen"),
                                                   F.lit(refused[c]).alias("refused_without")) for c in K.REQUIRED_COLUMNS])))
