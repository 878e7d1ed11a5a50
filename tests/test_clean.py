"""Cleaning steps on a hand-written export; expected values worked out by hand:
kept rows A1 A2 A3 A4 A5 A6 A9(second copy) None(first) A10.
Transit of lane SE -> DE / Standard: 2 6 4 3 5 2 -> median 3.5 -> 4 (half even).
Costs before imputation: 100 92 87 80 60 90 70 40 -> global median 83.5."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F


def rows_by_id(build):
    return {r.order_id: r for r in build.table.collect()}


def test_dispositions_and_counts(fixture_build):
    a = fixture_build.annotated
    got = {r["_removed"]: r["count"] for r in a.groupBy("_removed").count().collect()}
    assert got == {None: 9, "ship_date missing or unparseable": 3,
                   "duplicate order_id re-exported by source system": 2}


def test_first_in_file_order_survives(fixture_build):
    t = rows_by_id(fixture_build)
    assert t["A1"].freight_cost_eur == Decimal("100.00")          # not the 999 re-export
    assert t["A9"].ship_date == dt.date(2025, 3, 16)              # undated first copy does not shadow
    nulls = [r for r in fixture_build.table.collect() if r.order_id is None]
    assert len(nulls) == 1 and nulls[0].ship_date == dt.date(2025, 3, 17)


def test_dates(fixture_build):
    t = rows_by_id(fixture_build)
    for oid in ("A1", "A2", "A3", "A4", "A6"):
        assert t[oid].ship_date == dt.date(2025, 3, 14), oid
    assert t["A5"].ship_date == dt.date(2025, 3, 4)               # day first
    assert t["A1"].ship_weekday == "Friday"
    assert t["A1"].ship_week == dt.date(2025, 3, 10)
    assert t["A1"].ship_month == dt.date(2025, 3, 1)


def test_carriers_and_text(fixture_build):
    t = rows_by_id(fixture_build)
    assert [t[i].carrier for i in ("A1", "A2", "A3", "A4", "A5", "A6")] == [
        "Nordfrakt", "Nordfrakt", "Baltica Logistics", "Kestrel Parcel", "Hanseatic Line", "Acme Road"]
    assert t["A3"].status == "In Transit" and t["A3"].is_on_time
    assert t["A2"].service_level == "Standard"
    assert t["A10"].service_level == "Next-Day"
    assert t["A10"].destination_country is None and t["A10"].lane is None   # 'NA' reads as missing
    assert t["A1"].lane == "SE → DE"


def test_fx_and_cost_imputation(fixture_build):
    t = rows_by_id(fixture_build)
    assert t["A2"].freight_cost_eur == Decimal("92.00")
    assert t["A3"].freight_cost_eur == Decimal("87.00")
    assert t["A4"].freight_cost_eur == Decimal("83.50") and t["A4"].cost_is_imputed
    assert not t["A1"].cost_is_imputed
    assert t["A3"].cost_per_kg is None                               # zero weight
    assert t["A1"].cost_per_kg == Decimal("10.00")


def test_transit_imputation_and_derived(fixture_build):
    t = rows_by_id(fixture_build)
    assert t["A5"].transit_days == 4 and t["A5"].transit_days_imputed
    assert t["A6"].transit_days == 4 and t["A6"].transit_days_imputed   # voided negative
    c = t["A10"]
    assert c.is_cancelled and c.transit_days is None and c.delivery_date is None
    assert not c.transit_days_imputed and c.delay_days == 0 and not c.is_billable
    assert t["A2"].delay_days == 2 and t["A2"].is_late and t["A2"].late_penalty_eur == Decimal("90.00")
    assert t["A2"].delivery_date == dt.date(2025, 3, 20)
    assert not t["A2"].is_on_time


def test_kpis_hand_computed(fixture_build):
    from shipledger.operators.aggregates import kpis

    k = kpis(fixture_build.table).first().asDict()
    assert k["orders"] == 9 and k["cancelled_orders"] == 1 and k["active_orders"] == 8
    assert k["billable_orders"] == 8 and k["excluded_from_spend"] == 1
    assert k["total_spend"] == pytest.approx(662.5)
    assert k["on_time_pct"] == pytest.approx(75.0)
    assert k["avg_delay"] == pytest.approx(1.5)
    assert k["late_orders"] == 2 and k["penalties"] == pytest.approx(135.0)


def test_log_reconciles(fixture_build):
    from shipledger.operators import audit

    log = {(r.step, r.action): r for r in audit.cleaning_log(fixture_build).collect()}
    tot = audit.totals(fixture_build).first()
    assert tot.rows_in == 14 and tot.rows_removed == 5 and tot.rows_out == 9 and tot.reconciles
    removed = sum(r.rows_affected for (s, a), r in log.items() if a.startswith("REMOVED"))
    assert removed == tot.rows_removed
    assert log[("canonicalise_carrier", "FLAGGED unrecognised carrier name (kept as-is)")].detail == "['Acme Road']"
    assert log[("convert_currency", "FLAGGED unknown currency (cost left null)")].detail == \
        "1 distinct; listed in cleaning_log_values"
    values = {(r.step, r.value): r.rows for r in audit.cleaning_log_values(fixture_build).collect()}
    assert values == {("canonicalise_carrier", "Acme Road"): 1, ("convert_currency", "XYZ"): 1}
    assert log[("validate_transit", "voided negative transit_days (data-entry error)")].rows_affected == 1
    assert log[("ingest", "read source file")].rows_affected == 14


def test_null_status_is_an_error(spark):
    from shipment_rows import COLS, row
    from shipledger.plans.build import build_from_frames

    df = spark.createDataFrame([row("X1", "2025-01-02", "Nordfrakt", "SE", "DE", "Standard", "10", "EUR", "2", "4",
                                    None)], ", ".join(f"{c} string" for c in COLS))
    with pytest.raises(ValueError, match="is_cancelled"):
        build_from_frames(spark, {"one.csv": df})


def test_text_functions(spark):
    from shipledger.functions.text import strip_ws, title_case

    vals = ["next-day am 2nd", "IN TRANSIT", "o'neil", "2nd-day", "ÅSA öberg", "", None, "  x\t"]
    out = spark.createDataFrame([(v,) for v in vals], "v string").select(
        "v", title_case("v").alias("t"), strip_ws("v").alias("s")).collect()
    for r in out:
        assert r.t == (None if r.v is None else r.v.title())
        assert r.s == (None if r.v is None else r.v.strip())


def test_date_layouts(spark):
    from shipledger.functions.dates import parse_ship_date

    cases = {"2025-03-14": dt.date(2025, 3, 14), "14/03/2025": dt.date(2025, 3, 14),
             "Mar 14, 2025": dt.date(2025, 3, 14), "2025-03-14 00:00:00": dt.date(2025, 3, 14),
             "04/03/2025": dt.date(2025, 3, 4), "03/14/2025": dt.date(2025, 3, 14), "14.03.2025": dt.date(2025, 3, 14),
             "20250314": dt.date(2025, 3, 14), "14-Mar-2025": dt.date(2025, 3, 14), "junk": None, "": None,
             "14-03-2025": dt.date(2025, 3, 14), "2025-03-14T10:00:00Z": dt.date(2025, 3, 14),
             "14/03/2025 08:15": dt.date(2025, 3, 14), "14 March 2025": dt.date(2025, 3, 14),
             "2025-03-14 08:15:00.000": dt.date(2025, 3, 14), "March 14, 2025": dt.date(2025, 3, 14),
             "2025-3-14": dt.date(2025, 3, 14), "14/03/25": dt.date(2025, 3, 14), "2025/03/14": dt.date(2025, 3, 14),
             "2025-03-14T23:30:00+02:00": dt.date(2025, 3, 14), "2025-03-14T08:15:00": dt.date(2025, 3, 14),
             "14 Mar 2025": dt.date(2025, 3, 14), "14.03.2025 23:59": dt.date(2025, 3, 14),
             "04/03/99": dt.date(1999, 3, 4), "  2025-03-14\t": dt.date(2025, 3, 14), None: None,
             "31/02/2025": None, "2025-13-01": None, "14/14/2025": None, "2025-03-14 25:00:00": None, "14-Foo-2025": None,
             "32/01/2025": None, "1/2/345": None, "99999999": None, "0": None}
    got = {r.v: r.d for r in spark.createDataFrame([(k,) for k in cases], "v string")
           .select("v", parse_ship_date("v").alias("d")).collect()}
    assert got == cases


def test_exact_quantiles_by_hand(spark):
    """Linear interpolation, repeated values, a null-only group, a one-value group.
    g=a: 1 2 2 4 10 (+null) -> n 5; q1 at rank 1 = 2; median rank 2 = 2; q3 rank 3 = 4.
    g=b: 1 2 3 4 -> n 4; q1 pos 0.75 = 1.75; median pos 1.5 = 2.5; q3 pos 2.25 = 3.25.
    g=c: only nulls -> n 0, quantiles null. g=d: 7 -> every quantile 7."""
    from shipledger.operators.clean import exact_quantiles

    data = [("a", v) for v in (1.0, 2.0, 2.0, 4.0, 10.0, None)] + [("b", v) for v in (4.0, 3.0, 2.0, 1.0)] \
        + [("c", None), ("c", None), ("d", 7.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.n, r.q1, r.q2, r.q3)
           for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75], ["q1", "q2", "q3"]).collect()}
    assert got == {"a": (5, 2.0, 2.0, 4.0), "b": (4, 1.75, 2.5, 3.25), "c": (0, None, None, None),
                   "d": (1, 7.0, 7.0, 7.0)}


def test_exact_quantiles_match_percentile_on_a_hot_group(spark):
    """A group holding most rows, many repeated values: same as Spark's percentile."""
    from shipledger.operators.clean import exact_quantiles

    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 13).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 1009 / 4.0).alias("v"),
    )
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    names = [f"p{i}" for i in range(len(probs))]
    ours = {r.g: [r[n] for n in names] + [r.n] for r in exact_quantiles(df, ["g"], "v", probs, names).collect()}
    ref = {r.g: list(r.q) + [r.n] for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q"), F.count("v").alias("n")).collect()}
    assert ours.keys() == ref.keys()
    for g in ref:
        assert ours[g] == pytest.approx(ref[g], abs=1e-9), g


def test_custom_date_layouts(spark):
    from shipledger.functions.dates import parse_ship_date

    df = spark.createDataFrame([("2025|03|14",), ("14/03/2025",)], "v string")
    got = [r.d for r in df.select(parse_ship_date("v", ["yyyy|MM|dd"]).alias("d")).collect()]
    assert got == [dt.date(2025, 3, 14), None]


def wide(spark, n, **cols):
    """n shipments of distinct ids with the 15 required columns."""
    base = {"order_id": F.concat(F.lit("U"), F.col("id").cast("string")), "ship_date": F.lit("2025-03-14"),
            "carrier": F.lit("Nordfrakt"), "service_level": F.lit("Standard"), "currency": F.lit("EUR"),
            "freight_cost": (F.col("id") % 500).cast("string"), "transit_days": F.lit("2"), "promised_days": F.lit("4"),
            "status": F.lit("Delivered"), "weight_kg": F.lit("5"), **cols}
    from shipment_rows import COLS

    return spark.range(n).select(*[base.get(c, F.lit("SE")).alias(c) for c in COLS],
                                 *[v.alias(k) for k, v in cols.items() if k not in COLS])


@pytest.mark.parametrize("conf", [{}, {"spark.sql.shuffle.partitions": "64",
                                       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
                                       "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}])
def test_unique_ids_after_a_shuffle_all_survive(spark, conf):
    """Row positions are fixed by a write before anything refers to them."""
    from shipledger.plans.build import build_from_frames

    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        frame = wide(spark, 200_000).repartition("order_id")
        built = build_from_frames(spark, {"shuffled.csv": frame.unionByName(frame.limit(10))})
        assert built.table.count() == 200_000
        assert built.rejects().count() == 10
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_that_file_order_cannot_tell_apart_are_an_error(spark):
    from shipledger.plans.build import build_from_frames

    frame = wide(spark, 3, order_id=F.lit("same")).withColumn("_ord2", F.lit(1))
    with pytest.raises(ValueError, match="does not tell rows apart"):
        build_from_frames(spark, {"a.csv": frame})


def test_every_unknown_currency_is_listed(spark):
    from shipledger.operators import audit
    from shipledger.plans.build import build_from_frames

    built = build_from_frames(spark, {"a.csv": wide(spark, 90, currency=F.format_string("C%02d", F.col("id") % 30))})
    got = {r.value: r.rows for r in audit.cleaning_log_values(built).collect()}
    assert got == {f"C{i:02d}": 3 for i in range(30)}
    detail = [r.detail for r in audit.cleaning_log(built).collect() if "unknown currency" in r.action]
    assert detail == ["30 distinct; listed in cleaning_log_values"]


def test_log_order_and_values_used(spark):
    """6,000 files: their entries come first, in order; the texts state the rates used."""
    from shipledger.operators import audit
    from shipledger.operators.clean import clean

    raw = wide(spark, 6_000).withColumns({"source_file": F.format_string("f%04d.csv", F.col("order_id").substr(2, 9).cast("int")),
                                          "_file": F.col("order_id").substr(2, 9).cast("int"), "_ord1": F.col("order_id")})
    names = [f"f{i:04d}.csv" for i in range(6_000)]
    entries = spark.createDataFrame([(n, i, 15) for i, n in enumerate(names)], "source_file string, file_index int, n_columns int")
    built = clean(raw, sources=names, file_entries=entries, fx={"EUR": 1.0, "CHF": 1.05}, iqr=2.5, penalty=30)
    log = audit.cleaning_log(built).orderBy("seq").collect()
    assert [r.detail for r in log[:6_000]] == [f"{n} (15 columns)" for n in names]
    assert all(r.rows_affected == 1 for r in log[:6_000]) and len({r.seq for r in log}) == len(log)
    text = " | ".join(r.detail for r in log[6_000:])
    assert "rates: {'EUR': 1.0, 'CHF': 1.05}" in text and "multiplier 2.5" in text and "€30 per shipment" in text
    t = audit.totals(built).first()
    assert t.assumptions.fx_to_eur == '{"EUR":1.0,"CHF":1.05}' and t.assumptions.late_penalty_eur_per_day == 30.0


def test_log_without_file_entries(spark):
    from shipledger.operators import audit
    from shipledger.operators.clean import clean

    raw = wide(spark, 4).withColumns({"source_file": F.lit("x.csv"), "_ord1": F.col("order_id")})
    log = audit.cleaning_log(clean(raw)).collect()
    assert [(r.detail, r.rows_affected) for r in log if r.step == "ingest"] == [("x.csv", 4)]


def test_overrides_reach_the_table(spark):
    from shipledger.operators.clean import clean

    raw = wide(spark, 4, transit_days=F.lit("6")).withColumns({"source_file": F.lit("x.csv"), "_ord1": F.col("order_id")})
    row = clean(raw, penalty=10, central_europe=["SE"]).table.first()
    assert row.late_penalty_eur == Decimal("20.00") and row.is_central_europe


def test_plan_of_the_quantiles_holds_no_whole_group(spark, fixture_build):
    """Windows run over bucket totals and inside one bucket only."""
    from shipledger.operators.clean import group_stats

    kept = fixture_build.annotated.filter(F.col("_removed").isNull())
    plan = group_stats(kept)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line and "_c" in line.split("windowspec")[0]:
            assert "_b#" in line.split("], [")[1], line


def test_stage_folder_is_required_on_a_cluster(spark, monkeypatch):
    from shipledger import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.stage_root(Session())


def test_forget_deletes_stages(spark):
    import os

    from shipment_rows import SMOKE
    from shipledger.plans import build

    c = build.processed(spark, SMOKE)
    paths = [p.replace("file:", "") for p in c.stages]
    assert paths and all(os.path.isdir(p) for p in paths)
    assert build.processed(spark, SMOKE) is c
    build.forget(spark)
    assert not any(os.path.isdir(p) for p in paths)
    assert build.processed(spark, SMOKE) is not c


def test_stages_hold_keys_and_money_without_a_dictionary(spark, fixture_build):
    """A dictionary of values that hardly repeat takes time to make and is given up or large."""
    import glob

    import pyarrow.parquet as pq

    seen = {}
    for path in fixture_build.stages:
        for file in glob.glob(f"{path.replace('file:', '')}/*.parquet"):
            group = pq.ParquetFile(file).metadata.row_group(0)
            for c in (group.column(k) for k in range(group.num_columns)):
                seen.setdefault(c.path_in_schema, set()).add(c.has_dictionary_page)
    plain = ("order_id", "freight_cost", "freight_cost_eur", "cost_per_kg", "_ord._ord1")
    assert all(seen[c] == {False} for c in plain if c in seen) and {"order_id", "freight_cost", "freight_cost_eur"} <= set(seen)
    assert [c for c in seen if c.startswith("_ord.")] and all(v == {False} for c, v in seen.items() if c.startswith("_ord."))
    assert True in seen["carrier"] and True in seen["customer_segment"]
