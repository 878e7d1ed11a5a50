"""What a build and its writes hold on disk: shuffles go with the write that made them, a large
table is dealt in parts, later copies of an id are marked without a shuffle of whole rows,
and compressed exports are read."""

import datetime as dt
import gzip
import time

import pytest
from pyspark.sql import functions as F
from shipment_rows import COLS

from shipledger import session
from shipledger.operators import clean as C
from shipledger.sources import ingest, store

MAR, APR, MAY = dt.date(2025, 3, 1), dt.date(2025, 4, 1), dt.date(2025, 5, 1)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_a_written_stage_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    df = spark.range(1000).withColumn("k", F.col("id") % 10).repartition(7, "k")
    back = session.materialize(df, "dealt")
    for _ in range(100):  # they are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert back.count() == df.count() == 1000  # the frame may be used again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("sizes", [{MAR: 40, APR: 30, MAY: 20, None: 10}, {APR: 1000, MAR: 2}, {MAY: 100, dt.date(2030, 1, 1): 100}])
def test_a_large_table_is_written_in_parts_that_hold_every_row_once(spark, tmp_path, sizes, monkeypatch):
    months = F.element_at(F.array(*[F.lit(m) for m in (MAR, APR, MAY)], F.lit(None).cast("date")), (F.col("id") % 4 + 1).cast("int"))
    t = spark.range(100).select(F.concat(F.lit("N"), "id").alias("order_id"), F.date_add(months, (F.col("id") % 9).cast("int")).alias(
        "ship_date"), months.alias("ship_month"), (F.col("id") % 2 == 0).alias("_even"))
    written = []
    real = store.jit_sized
    monkeypatch.setattr(store, "jit_sized", lambda *a: (written.append(1), real(*a))[1])
    seen = store.write_processed(t, str(tmp_path / "pq"), counts=[F.count(F.lit(1)).alias("n"), F.count_if("_even").alias("even")],
                                 csv_path=str(tmp_path / "csv"), sizes=sizes, part_rows=50)
    assert len(written) > 2  # two parts at least, and the CSV
    assert seen == {"n": 100, "even": 50}
    want = _rows(t.drop("_even"))
    assert _rows(spark.read.parquet(str(tmp_path / "pq")).select("order_id", "ship_date", "ship_month")) == want
    csv = spark.read.schema("order_id string, ship_date date, ship_month date").option("header", True).csv(str(tmp_path / "csv"))
    assert _rows(csv) == want
    # a text as folder name: the CSV is made from the frame
    texts = t.select("order_id", F.date_format("ship_month", "MMM").alias("m"))
    store.write_processed(texts, str(tmp_path / "t"), csv_path=str(tmp_path / "t_csv"), partition_by="m",
                          sizes={"Mar": 25, "Apr": 25, "May": 25, None: 25}, part_rows=30)
    assert spark.read.option("header", True).csv(str(tmp_path / "t_csv")).count() == 100
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_a_failing_part_leaves_no_part(spark, tmp_path):
    t = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("A").alias("order_id"),
                              F.when(F.col("id") < 2, F.lit(MAR)).otherwise(F.lit(APR)).alias("ship_month"))
    with pytest.raises(Exception, match="lost"):
        store.write_processed(t, str(tmp_path / "pq"), sizes={MAR: 2, APR: 2}, part_rows=2)
    assert not (tmp_path / "pq").exists()


def test_parts_are_as_large_as_allowed():
    assert store.partition_parts({3: 5, 1: 4, None: 9, 2: 6}, 10) == [None, 3]
    assert store.partition_parts({1: 50, 2: 1, 3: 9}, 10) == [None, 2]
    assert store.partition_parts({}, 10) == [None]


def test_later_copies_are_marked_without_a_shuffle_of_rows(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT CASE WHEN id % 7 = 0 THEN NULL ELSE concat('ORD-', id % 4001) END AS order_id, repeat('x', id % 5) AS note,
                 IF(id % 11 = 0, NULL, DATE '2025-01-01') AS ship_date, id % 13 = 0 AS _surplus,
                 struct(id % 3 AS _ord1, id AS _ord2) AS _ord FROM range(0, 20000, 1, 3)""").write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    want, spare = C.disposition(stored)
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", -1)
    stages = []
    got, again = C.disposition(C.placed(stored), stages)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert got.columns == want.columns and spare == again and len(stages) == 1
    assert got.filter(F.col("_removed").isNotNull()).count() > 4096
    assert _rows(got) == _rows(want)
    monkeypatch.setattr(C, "MARKS_MAX_BYTES", -1)  # too many rows for the marks: joined by id
    joined, _ = C.disposition(C.placed(stored), [])
    assert "Exchange hashpartitioning" in joined._jdf.queryExecution().executedPlan().toString()
    assert _rows(joined) == _rows(want)


def test_compressed_exports_are_read(spark, tmp_path):
    lines = [",".join([*COLS, "x" * 300]), ",".join(["A1", "2025-03-14", *["a"] * 13, "p"]), ",".join(["A2", "2025-03-15", *["b"] * 13, ""])]
    plain, packed = tmp_path / "a.csv", tmp_path / "b.csv.gz"
    plain.write_text("\n".join(lines) + "\n")
    packed.write_bytes(gzip.compress(plain.read_bytes()))
    heads = ingest.read_headers(spark, [f"file:{plain}", f"file:{packed}"], first_bytes=64)
    assert set(heads.values()) == {lines[0]}
    raw = ingest.read_exports(spark, [str(plain), str(packed)]).raw
    assert sorted((r.source_file, r.order_id) for r in raw.collect()) == [
        (n, o) for n in ("a.csv", "b.csv.gz") for o in ("A1", "A2")]
