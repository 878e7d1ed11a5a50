"""Versions, incremental rebuilds, rebalanced writes and order-free parity."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F
from shipment_rows import COLS

from shipledger.operators import aggregates as A
from shipledger.operators import audit
from shipledger.plans import incremental
from shipledger.plans.build import build_from_files
from shipledger.sources import store
from shipledger.sources import versions as VS
from shipledger.streaming import freshness


def export(path, rows, head=COLS):
    path.write_text("\n".join([",".join(head), *[",".join("" if v is None else str(v) for v in r) for r in rows]]) + "\n")
    past = time.time() - 100 + len(rows)
    os.utime(path, (past, past))


def shipments(lo, hi, cost=100, lane="DE", carrier="Nordfrakt"):
    """Every seventh without transit days, every ninth without a cost."""
    return [(f"N{i}", f"2025-0{1 + i % 3}-{1 + i % 27:02d}", carrier, "Malmo", "SE", "Kiel", lane, "Standard", "retail", 10,
             None if i % 9 == 0 else cost + i % 40, "EUR", None if i % 7 == 0 else 1 + i % 6, 4, "Delivered") for i in range(lo, hi)]


@pytest.fixture
def source(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    export(src / "b.csv", shipments(0, 60))
    export(src / "c.csv", shipments(50, 120, 200, "PL", "Kestrel Parcel"))  # 50-59 again: the first copy counts
    return src


def rows(df):
    def flat(v):
        return float(v) if hasattr(v, "quantize") else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(flat(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


def same_as_full_build(spark, source, root):
    version, full = VS.current(spark, root), build_from_files(spark, str(source))
    assert store.parity(version.table(spark), full.table).count() == 0
    assert version.table(spark).count() == full.table.count()
    assert rows(A.kpis(version.cube(spark))) == rows(A.kpis(full.table))
    log = [(r.seq, r.step, r.action, r.rows_affected, r.detail) for r in version.log(spark).orderBy("seq").collect()]
    assert log == [tuple(r) for r in audit.cleaning_log(full).select("seq", "step", "action", "rows_affected", "detail")
                   .orderBy("seq").collect()]
    stats = spark.read.parquet(f"{version.path}/stats")
    assert rows(stats) == rows(full.stats.select(*stats.columns))
    return version


def test_added_changed_and_removed_exports_equal_a_full_build(spark, source, tmp_path):
    root = str(tmp_path / "out")
    first = incremental.rebuild(spark, str(source), root)
    assert first.number == 1 and same_as_full_build(spark, source, root).name == first.name
    assert incremental.rebuild(spark, str(source), root) is None
    groups = spark.read.parquet(f"{first.path}/stats").count()

    # an earlier name: its rows come first, so copies elsewhere go; another lane, so old medians stand
    export(source / "a.csv", shipments(100, 140, 900, "AT", "Hanseatic Line"))
    second = incremental.rebuild(spark, str(source), root)
    same_as_full_build(spark, source, root)
    kept = {f["path"]: f["batch"] for f in first.info["files"]}
    assert [f["batch"] == kept.get(f["path"]) for f in second.info["files"]] == [False, True, True]
    assert 0 < second.info["groups_recomputed"] < groups + 3

    export(source / "c.csv", [*shipments(50, 90, 300, "PL", "Kestrel Parcel"), ("X", "junk", *[None] * 13)])
    third = incremental.rebuild(spark, str(source), root)
    same_as_full_build(spark, source, root)
    assert third.number == 3

    os.remove(source / "b.csv")  # held the first copies of 50-59
    assert freshness.is_stale(spark, str(source), root)
    fourth = incremental.rebuild(spark, str(source), root)
    same_as_full_build(spark, source, root)
    assert not set(f["batch"] for f in fourth.info["files"]) - {f["batch"] for f in third.info["files"]}  # nothing parsed
    assert fourth.table(spark).filter("order_id = 'N55'").first().carrier == "Kestrel Parcel"


def test_exports_with_other_columns_and_settings(spark, source, tmp_path):
    root = str(tmp_path / "out")
    first = incremental.rebuild(spark, str(source), root)
    export(source / "d.csv", [(*r, "CC") for r in shipments(300, 320)], [*COLS, "Cost Centre"])
    second = incremental.rebuild(spark, str(source), root)
    same_as_full_build(spark, source, root)
    assert "cost_centre" in second.table(spark).columns and "cost_centre" not in first.table(spark).columns
    third = incremental.rebuild(spark, str(source), root, fx={"EUR": 2.0})
    assert float(third.table(spark).agg(F.max("freight_cost_eur")).first()[0]) == 2 * float(
        second.table(spark).agg(F.max("freight_cost_eur")).first()[0])
    with pytest.raises(TypeError, match="unknown settings"):
        incremental.rebuild(spark, str(source), root, currency="EUR")


def test_a_rebuild_that_fails_leaves_the_old_version(spark, source, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    first = incremental.rebuild(spark, str(source), root)
    before = rows(freshness.open_processed(spark, root))
    export(source / "d.csv", shipments(400, 420))
    for where in ("write_processed", "write_log"):
        def broken(*args, **kw):
            raise OSError("disk gone")
        with monkeypatch.context() as m:
            m.setattr(store, where, broken)
            with pytest.raises(OSError, match="disk gone"):
                incremental.rebuild(spark, str(source), root)
        assert VS.current(spark, root).name == first.name and rows(freshness.open_processed(spark, root)) == before
        assert freshness.is_stale(spark, str(source), root)
    assert freshness.ensure_processed(spark, str(source), root)
    same_as_full_build(spark, source, root)


def test_a_null_status_is_never_published(spark, source, tmp_path):
    root = str(tmp_path / "out")
    bad = [list(r) for r in shipments(500, 503)]
    bad[1][-1] = None
    export(source / "e.csv", bad)
    with pytest.raises(ValueError, match="is_cancelled"):
        incremental.rebuild(spark, str(source), root)
    assert VS.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        freshness.open_processed(spark, root)


def test_of_two_rebuilds_one_publishes(spark, tmp_path):
    root = str(tmp_path / "out")
    VS.publish(spark, root, "one", 0, {"files": []})
    with pytest.raises(VS.Conflict):
        VS.publish(spark, root, "two", 0, {"files": []})
    assert VS.current(spark, root).name == "one"
    assert [n for n in os.listdir(f"{root}/commits") if "two" in open(f"{root}/commits/{n}", errors="ignore").read()] == []


def test_old_versions_are_dropped_and_kept_ones_stay_whole(spark, source, tmp_path):
    root = str(tmp_path / "out")
    incremental.rebuild(spark, str(source), root)
    for k in range(3):
        export(source / f"n{k}.csv", shipments(600 + 10 * k, 605 + 10 * k))
        incremental.rebuild(spark, str(source), root)
    os.makedirs(f"{root}/versions/unfinished")
    gone = VS.drop_old(spark, root, keep=2)
    assert sorted(os.listdir(f"{root}/versions")).count("unfinished") == 1  # may still be running
    assert len([g for g in gone if g.startswith("commits/")]) == 2
    assert len([n for n in os.listdir(f"{root}/commits") if n.isdigit()]) == 2
    same_as_full_build(spark, source, root)
    assert "versions/unfinished" in VS.drop_old(spark, root, keep=2, unfinished_hours=-1)
    export(source / "n9.csv", shipments(700, 705))
    incremental.rebuild(spark, str(source), root)  # batches that kept versions name are still there
    same_as_full_build(spark, source, root)


def many(spark, n, hot):
    """n rows a month of 2024, ``hot`` in one of them."""
    per = F.when(F.col("m") == 5, hot).otherwise(n)
    days = spark.range(12).withColumnRenamed("id", "m").select("m", F.explode(F.sequence(F.lit(1), per)).alias("i"))
    first = F.expr("make_date(2024, cast(m + 1 as int), 1)")
    return days.repartition(16).select(
        F.concat("m", F.lit("-"), "i").alias("order_id"), F.date_add(first, (F.col("i") % 28).cast("int")).alias("ship_date"),
        F.sha2(F.col("i").cast("string"), 512).alias("note"), first.alias("ship_month"))


def test_rebalanced_write_bounds_files_and_splits_a_hot_month(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "600k")
    spark.conf.set("spark.sql.shuffle.partitions", "200")  # many more than months, as on a cluster
    try:
        store.write_processed(many(spark, 200, 40_000), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = {d: [f for f in os.listdir(tmp_path / "t" / d) if f.endswith(".parquet")] for d in os.listdir(tmp_path / "t")
             if d.startswith("ship_month=")}
    assert len(files) == 12
    hot = len(files["ship_month=2024-06-01"])
    assert hot >= 3 and all(len(f) <= hot for f in files.values())
    assert sum(len(f) > 1 for f in files.values()) <= 2  # a month whose hash falls beside the hot one's is split with it
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 11 * 200 + 40_000
    per_file = {}
    for r in back.select(F.input_file_name().alias("f"), "ship_date").collect():
        per_file.setdefault(r.f, []).append(r.ship_date)
    assert all(days == sorted(days) for days in per_file.values())
    store.write_processed(many(spark, 50, 1000), str(tmp_path / "small"), file_rows=400)
    assert len([f for f in os.listdir(tmp_path / "small" / "ship_month=2024-06-01") if f.endswith(".parquet")]) >= 3


def test_parity_finds_a_changed_a_lost_and_a_doubled_row(spark, fixture_build):
    t = fixture_build.table
    assert store.parity(t, t.repartition(5)).count() == 0
    assert store.parity(t.limit(0), t.limit(0)).count() == 0
    one = t.filter("order_id = 'A2'")
    assert one.count() == 1
    changed = t.withColumn("weight_kg", F.when(F.col("order_id") == "A2", 77.0).otherwise(F.col("weight_kg")))
    sides = [(r.order_id, r._side) for r in store.parity(t, changed).collect()]
    assert sorted(sides) == [("A2", "left_only"), ("A2", "right_only")]
    lost = t.filter("order_id <> 'A2' OR order_id IS NULL")
    assert [(r.order_id, r._side) for r in store.parity(t, lost).collect()] == [("A2", "left_only")]
    doubled = t.unionByName(one)
    assert [(r.order_id, r._side) for r in store.parity(t, doubled).collect()] == [("A2", "right_only")]
    swapped = t.withColumn("origin_city", F.when(F.col("order_id") == "A2", F.lit(None)).otherwise(F.col("origin_city")))
    assert store.differing_groups(t, swapped).collect()[0][0] == dt.date(2025, 3, 1)


def test_fingerprints_shuffle_no_rows(spark, fixture_build):
    t = fixture_build.table
    plan = t._sc._jvm.PythonSQLUtils.explainString(store.differing_groups(t, t.repartition(3))._jdf.queryExecution(), "formatted")
    import re

    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert exchanges and all("order_id" not in e or "repartition" in e or len(e.split(",")) > 20 for e in exchanges)
    left = t._sc._jvm.PythonSQLUtils.explainString(store.fingerprint(t)._jdf.queryExecution(), "formatted")
    (moved,) = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", left)
    assert "order_id" not in moved and len(moved.split(",")) <= 8
