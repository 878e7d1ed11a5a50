"""Registered queries answered from the stored cube: every output of one view
(date range and carrier list), and the same per slice in one job."""

from __future__ import annotations

from shipledger.operators import aggregates as A
from shipledger.operators import cube as C
from shipledger.operators import views as V
from shipledger.plans import build
from shipledger.plans import oracle as O
from shipledger.plans import oracle_findings as OF
from shipledger.plans import registry_metrics as RM
from shipledger.plans.registry import CARRIER_SQL, KPI_SQL, register
from shipledger.plans.registry_findings import FINDING_COLS, per_segment
from shipledger.plans.registry_steps import trend_sql_ctes

START, END, CARRIERS = "1995-06-15", "1997-10-20", ("Nordfrakt", "Kestrel Parcel", "Meridian Express", "Hanseatic Line")
WHERE = (f"ship_date BETWEEN DATE '{START}' AND DATE '{END}' AND carrier IN ({', '.join(O.q(c) for c in CARRIERS)})")


def in_view(sql: str) -> str:
    """A query over the shipments of the view alone (DuckDB side)."""
    whole = "shipments AS (SELECT * FROM full_)"
    if whole not in sql:
        raise ValueError("the query does not read the shipments chain")
    return sql.replace(whole, f"shipments AS (SELECT * FROM full_ WHERE {WHERE})")


def _view(spark, sf_dir, **kw) -> C.View:
    return C.build_view(build.cube(spark, sf_dir), START, END, CARRIERS, **kw)


def _carriers_sql() -> str:
    return O.base_ctes() + f"\nSELECT {CARRIER_SQL}\nFROM shipments WHERE carrier IS NOT NULL GROUP BY carrier"


def _trend_sql(grain: str = "week", col: str = "ship_week") -> str:
    return RM._sql("SELECT * FROM _tr", *trend_sql_ctes("shipments", col, grain, "_tr"))


OUTPUTS = {
    "kpis": lambda: O.base_ctes() + f"\nSELECT {KPI_SQL}\nFROM shipments",
    "bounds": lambda: RM._sql("SELECT min(ship_date) AS first_date, max(ship_date) AS last_date FROM shipments"),
    "carriers": _carriers_sql,
    "totals": RM._totals_sql,
    "trend": _trend_sql,
    "last_weeks": RM._last13_sql,
    "matrix": lambda: RM._matrix_sql(None),
    "weekdays": lambda: RM._sql("SELECT * FROM effects", *RM.effects_ctes()),
    "lanes": lambda: RM._sql("SELECT * FROM lanes", *RM.lanes_ctes()),
    "composition": RM._composition_sql,
    "findings": OF.findings_sql,
    "cites": OF.cites_sql,
    "evidence": OF.evidence_sql,
    "summary": OF.summary_sql,
    "brief": OF.brief_sql,
    "brief_audit": OF.brief_audit_sql,
}

for _name, _make in OUTPUTS.items():
    def _mk(name=_name, make=_make):
        @register(f"view_{name}", lambda: in_view(make()))
        def q(spark, sf_dir):
            out = getattr(_view(spark, sf_dir), name)
            return out.select(*FINDING_COLS) if name == "findings" else out
        return q
    _mk()


def _carriers_only(sql: str) -> str:
    """The carrier list alone; the windows of the query set its dates."""
    return sql.replace("shipments AS (SELECT * FROM full_)", "shipments AS (SELECT * FROM full_ WHERE carrier IN ("
                       + ", ".join(O.q(c) for c in CARRIERS) + "))")


WINDOW = f"SELECT DATE '{START}' AS _st, DATE '{END}' AS _en"


@register("view_change", lambda: _carriers_only(RM._change_sql(WINDOW)))
def q_view_change(spark, sf_dir):
    return _view(spark, sf_dir).change


# --- every slice in one job, from the cube -------------------------------------------

BY_SEGMENT = {
    "bounds": lambda: RM._sql("SELECT min(ship_date) AS first_date, max(ship_date) AS last_date FROM shipments"),
    "book_cost": lambda: RM._sql(
        f"SELECT {RM.msum('CASE WHEN is_billable THEN freight_cost_eur END')} / "
        "CAST(greatest(count_if(is_billable), 1) AS DOUBLE) AS book_cost_per_shipment FROM shipments"),
    "totals": RM._totals_sql,
    "trend": lambda: _trend_sql("month", "ship_month"),
    "last_weeks": RM._last13_sql,
    "matrix": lambda: RM._matrix_sql(None),
    "lanes": lambda: RM._sql("SELECT * FROM lanes", *RM.lanes_ctes()),
    "change": lambda: RM._change_sql(WINDOW),
}
_SLICED = {
    "bounds": lambda c, by: V.bounds(c, by),
    "book_cost": lambda c, by: A.book_cost_per_shipment(c, by),
    "totals": lambda c, by: A.carrier_totals(c, by),
    "trend": lambda c, by: A.trend(c, "month", by=by),
    "last_weeks": lambda c, by: A.kpi_last_weeks(c, by=by),
    "matrix": lambda c, by: A.lane_matrix(c, by=by),
    "lanes": lambda c, by: A.worst_lanes(c, by=by),
    "change": lambda c, by: A.kpi_change(V.with_prior(c, V.window_dates(START, END)), by=by),
}

for _name, _make in BY_SEGMENT.items():
    def _mk_sliced(name=_name, make=_make):
        @register(f"segment_{name}", lambda: per_segment(make()))
        def q(spark, sf_dir):
            return _SLICED[name](build.cube(spark, sf_dir), "customer_segment")
        return q
    _mk_sliced()
