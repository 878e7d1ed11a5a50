"""The stored cube: every output of a view equals the one over the shipments,
slices equal their own runs, and no view reads the shipments."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from shipment_rows import SMOKE

from shipledger.operators import aggregates as A
from shipledger.operators import cube as C
from shipledger.operators import findings as FD
from shipledger.operators import views as V

pytestmark = pytest.mark.skipif(not os.path.exists(SMOKE), reason="driver tables not present")
WINDOW = (dt.date(1995, 3, 1), dt.date(1996, 2, 20))
CARRIERS = ("Nordfrakt", "Kestrel Parcel", "Hanseatic Line")


@pytest.fixture(scope="module")
def built(spark):
    from shipledger.plans.build import processed

    return processed(spark, SMOKE)


def rows(df):
    def flat(v):
        return round(v, 6) if isinstance(v, float) else float(v) if hasattr(v, "quantize") else v
    return sorted((tuple(flat(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


OUTPUTS = {
    "bounds": lambda d, by: V.bounds(d, by), "kpis": lambda d, by: A.kpis(d, by),
    "carriers": lambda d, by: A.spend_by_carrier(d, by), "totals": lambda d, by: A.carrier_totals(d, by),
    "trend": lambda d, by: A.trend(d, by=by), "last_weeks": lambda d, by: A.kpi_last_weeks(d, by=by),
    "matrix": lambda d, by: A.lane_matrix(d, by=by), "weekdays": lambda d, by: A.weekday_effects(d, by=by),
    "lanes": lambda d, by: A.worst_lanes(d, by=by), "composition": lambda d, by: A.composition(d, by=by),
    "findings": lambda d, by: FD.findings(d, by), "evidence": lambda d, by: FD.evidence(d, by),
    "summary": lambda d, by: FD.executive_summary(d, by), "brief": lambda d, by: FD.brief(d, by),
}


@pytest.mark.parametrize("name", OUTPUTS)
def test_view_equals_the_shipments(built, name):
    view = C.build_view(built.cube, *WINDOW, CARRIERS)
    assert rows(getattr(view, name)) == rows(OUTPUTS[name](V.filter_view(built.table, *WINDOW, CARRIERS), None))


def test_change_equals_the_shipments(built):
    view = C.build_view(built.cube, *WINDOW, CARRIERS)
    assert view.prior_days == 357
    assert rows(view.change) == rows(A.kpi_change(V.with_prior(built.table, WINDOW, CARRIERS)))


@pytest.mark.parametrize("name", ["bounds", "kpis", "totals", "trend", "last_weeks", "matrix", "lanes", "change"])
def test_each_slice_equals_its_own_run(built, name):
    sliced = getattr(C.build_view(built.cube, *WINDOW, by="service_level"), name)
    levels = [r[0] for r in built.cube.select("service_level").distinct().collect()]
    got = {s: rows(sliced.filter(F.col("service_level").eqNullSafe(s)).drop("service_level")) for s in levels}
    alone = {s: rows(getattr(C.build_view(built.cube.filter(F.col("service_level").eqNullSafe(s)), *WINDOW), name))
             for s in levels}
    assert got == alone and len(levels) > 1


def test_a_view_reads_no_shipments_and_prunes_days(built):
    view = C.build_view(built.cube, *WINDOW, CARRIERS)
    whole = {p for p in built.table.inputFiles()}
    for name in ("kpis", "carriers", "trend", "matrix", "lanes", "findings", "summary", "change"):
        assert not whole & set(getattr(view, name).inputFiles())
    plan = view.kpis._sc._jvm.PythonSQLUtils.explainString(view.kpis._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(ship_date,1995-03-01)" in plan and "LessThanOrEqual(ship_date,1996-02-20)" in plan
    assert plan.count("Scan parquet") <= 2  # once, shown in the tree and in the details


def test_lanes_and_totals_scan_once(built):
    for df in (A.worst_lanes(built.table), A.carrier_totals(built.table), A.trend(built.table)):
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert plan.count("FileScan parquet") == 1, plan


def test_cube_round_trip_and_empty_view(spark, built, tmp_path):
    C.write_cube(built.table, str(tmp_path / "cube"))
    cube = C.read_cube(spark, str(tmp_path / "cube"))
    assert rows(A.kpis(cube)) == rows(A.kpis(built.table))
    empty = C.build_view(cube, "1900-01-01", "1900-02-01")
    k = empty.kpis.first()
    assert (k.orders, k.total_spend, k.on_time_pct) == (0, 0.0, 0.0) and empty.findings.count() == 0
    assert empty.trend.count() == 0 and empty.change.count() == 0 and empty.summary.count() == 1
    with pytest.raises(ValueError, match="no cube"):
        built.table.write.parquet(str(tmp_path / "t"))
        C.read_cube(spark, str(tmp_path / "t"))


def test_cube_merges_by_any_grain(built):
    month = C.grouped(built.cube, ["ship_month", "carrier"])
    assert rows(A.kpis(month)) == rows(A.kpis(built.table))
    assert rows(V.bounds(built.cube)) == rows(built.table.agg(F.min("ship_date").alias("first_date"),
                                                              F.max("ship_date").alias("last_date")))


def test_records_and_cites(built):
    recs = {r.key: r for r in FD.records(built.table).collect()}
    ev = {(r.key, r.row_no): r for r in FD.evidence(built.table).collect()}
    cites = {(r.key, r.column): r for r in FD.finding_cites(built.table).collect()}
    assert recs and len(cites) == sum(len(r.cite) for r in recs.values())
    for key, r in recs.items():
        assert len(r.support) == 3 and r.figure.eur == r.leak_eur
        shown = {c.name for c in r.columns}
        for c in r.cite:
            assert c.column in shown
            cell = ev[key, c.row_no][c.column]
            found = cites[key, c.column]
            assert found.value == pytest.approx(float(cell)) and found.quoted_in is not None
            assert found.shown in r.claim + " ".join(r.support)
