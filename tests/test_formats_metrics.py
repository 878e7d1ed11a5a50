"""Formatting (X1-X7) and aggregate edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F


def fmt(spark, make, values, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(make("v")).collect()]


def test_money_and_numbers(spark):
    from shipledger.functions import formats as X

    n, m = "\u202f", "\u2212"
    assert fmt(spark, X.fmt_money, [1530.0, 184212.0, 812.0, 1240000.0, 12400000.0, 1.2e9, None]) == [
        f"EUR{n}1.5k", f"EUR{n}184k", f"EUR{n}812", f"EUR{n}1.24M", f"EUR{n}12.4M", f"EUR{n}1.2bn", "none"]
    assert fmt(spark, lambda c: X.fmt_money(c, exact=True), [1530.0, -11600.0]) == [
        f"EUR{n}1{n}530", f"EUR{n}{m}11{n}600"]
    assert fmt(spark, lambda c: X.fmt_group(c, 1), [1204812.45, -0.04]) == [f"1{n}204{n}812.5", "0.0"]
    assert fmt(spark, X.fmt_pct, [12.44, 0.125, -3.0, 0.0]) == ["12.4%", "0.13%", f"{m}3.0%", "0.0%"]
    assert fmt(spark, X.fmt_pts, [1.84, -0.04, -2.0]) == ["+1.8 pts", "0.0 pts", f"{m}2.0 pts"]
    assert fmt(spark, X.fmt_days, [1.25]) == ["1.3 days"]


def test_dates(spark):
    from shipledger.functions import formats as X

    d = [dt.date(2026, 9, 11)]
    assert fmt(spark, X.fmt_week, d, "date") == ["W37 2026"]
    assert fmt(spark, X.fmt_week, [dt.date(2027, 1, 1)], "date") == ["W53 2026"]
    assert fmt(spark, X.fmt_iso, d, "date") == ["2026-09-11"]
    assert fmt(spark, X.fmt_month, d, "date") == ["September 2026"]
    assert fmt(spark, X.fmt_prose_date, d, "date") == ["11 September 2026"]


def test_carrier_table_reconciles(fixture_build):
    from shipledger.operators import aggregates as A

    t = fixture_build.table
    bc = A.spend_by_carrier(t).orderBy("carrier_rank", "carrier").collect()
    k = A.kpis(t).first()
    assert [r.carrier for r in bc] == ["Nordfrakt", "Baltica Logistics", "Kestrel Parcel", "Hanseatic Line", "Acme Road"]
    assert sum(r.orders for r in bc) == k.orders
    assert sum(r.billable_orders for r in bc) == k.billable_orders
    assert abs(sum(r.spend for r in bc) - k.total_spend) < 1.0


def test_empty_and_unbillable_views(fixture_build):
    from shipledger.operators import aggregates as A
    from shipledger.operators import views as V

    t = fixture_build.table
    empty = V.filter_view(t, "1990-01-01", "1990-01-02")
    assert A.spend_by_carrier(empty).count() == 0
    k = A.kpis(empty).first()
    assert k.orders == 0 and k.total_spend == 0.0 and k.on_time_pct == 0.0
    unbillable = t.filter(~F.col("is_billable"))
    ub = A.spend_by_carrier(unbillable).collect()
    assert len(ub) == 1 and ub[0].spend == 0.0 and ub[0].on_time_pct is None
    only = V.filter_view(t, "2025-03-01", "2025-03-31", ["Nordfrakt"])
    assert {r.carrier for r in only.collect()} == {"Nordfrakt"}


def test_kpi_change_and_prior_window(spark, fixture_build):
    from shipledger.operators import aggregates as A
    from shipledger.operators import views as V

    w = spark.createDataFrame([(dt.date(2025, 3, 15), dt.date(2025, 3, 18))], "start date, end date")
    lab = V.with_prior(fixture_build.table, w)
    got = {r.window: r["count"] for r in lab.groupBy("window").count().collect()}
    assert got == {"current": 3, "prior": 5}          # prior = 11..14 March (A1-A4, A6)
    ch = {r.kpi: r for r in A.kpi_change(lab, min_prior=1).collect()}
    assert ch["orders"].current == 3 and ch["orders"].prior == 5 and ch["orders"].direction == "down"
    assert ch["orders"].delta == pytest.approx(-40.0) and ch["orders"].prior_days == 4
    none = {r.kpi: r for r in A.kpi_change(lab).collect()}   # prior below 20 rows: no comparison
    assert none["orders"].delta is None and none["orders"].direction is None


def test_matrix_floor_and_trend(fixture_build):
    from shipledger.operators import aggregates as A

    m = A.lane_matrix(fixture_build.table, min_shipments=2).collect()
    for r in m:
        assert (r.on_time_pct is None) == (r.shipments < 2)
        if r.on_time_pct is not None:
            assert r.late_pct == pytest.approx(100 - r.on_time_pct)
    tr = A.trend(fixture_build.table, "day").collect()
    assert sum(r.orders for r in tr) == 8                 # active rows only


def test_weekday_effects_scope_arithmetic(spark):
    """A carrier into DE: 10 Friday shipments at 6 days, 30 other days at 3."""
    from shipledger.operators import aggregates as A

    rows = []
    start = dt.date(2025, 1, 6)   # a Monday
    for i in range(40):
        d = start + dt.timedelta(days=(4 if i < 10 else (i % 4)) + 7 * (i % 5))
        transit = 6 if i < 10 else 3
        rows.append(("Nordfrakt", "DE", d, d.strftime("%A"), transit, transit > 4, False, 45.0 * max(transit - 4, 0)))
    df = spark.createDataFrame(rows, "carrier string, destination_country string, ship_date date, ship_weekday string, "
                                     "transit_days int, is_late boolean, is_cancelled boolean, late_penalty_eur double")
    df = df.withColumn("late_penalty_eur", F.col("late_penalty_eur").cast("decimal(18,2)"))
    e = A.weekday_effects(df).collect()
    assert len(e) == 1 and e[0].weekday == "Friday" and e[0].region == "Central Europe"
    assert e[0].shipments == 10 and e[0].baseline_shipments == 30
    assert e[0].transit_uplift_pct == pytest.approx(100.0)
    assert e[0].late_pct == 100.0 and e[0].baseline_late_pct == 0.0
    s = A.weekday_signal(df).collect()
    assert len(s) == 1 and s[0].penalties_eur == pytest.approx(900.0)


def test_worst_lanes_by_slice_equals_each_slice_alone(fixture_build):
    """A10/A17 with by=: the same lanes, ranks and book rate as running the
    query on each slice's rows alone (book rate over all active rows of it)."""
    from shipledger.operators import aggregates as A

    t = fixture_build.table
    cols = ["carrier", "destination_country", "orders", "late_pct", "penalties", "lane_rank", "book_late_pct"]
    sliced = {(r.customer_segment, r.lane_rank): tuple(r[c] for c in cols)
              for r in A.worst_lanes(t, min_shipments=1, by="customer_segment").collect()}
    alone = {}
    for seg in [r.customer_segment for r in t.select("customer_segment").distinct().collect()]:
        part = t.filter(F.col("customer_segment").eqNullSafe(seg))
        for r in A.worst_lanes(part, min_shipments=1).collect():
            alone[(seg, r.lane_rank)] = tuple(r[c] for c in cols)
    assert sliced == alone and sliced
