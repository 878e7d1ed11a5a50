"""Registered queries for views and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipledger import constants as K
from shipledger.functions import formats as X
from shipledger.operators import aggregates as A
from shipledger.operators import views as V
from shipledger.plans import oracle as O
from shipledger.plans.build import processed
from shipledger.plans.registry import CARRIER_SQL, KPI_SQL, carrier_rank_sql, cnt, msum, pct, register
from shipledger.plans.registry_steps import trend_sql_ctes


def _sql(body: str, *extra: str) -> str:
    return O.with_ctes(*extra) + "\n" + body


def _table(spark, sf_dir):
    return processed(spark, sf_dir).table


def _preset_sql(name: str, weeks: int | None) -> str:
    if weeks is None:
        return f"{name} AS (SELECT * FROM shipments)"
    return (f"{name} AS (SELECT s.* FROM shipments s, (SELECT greatest(min(ship_date), max(ship_date) - {7 * weeks}) "
            f"AS _st, max(ship_date) AS _en FROM shipments) w WHERE s.ship_date BETWEEN w._st AND w._en)")


# --- A1 by slice --------------------------------------------------------------

@register("kpis_by_segment_month",
          lambda: _sql(f"SELECT customer_segment, ship_month, {KPI_SQL}\nFROM shipments GROUP BY customer_segment, ship_month"))
def q_kpis_by_segment_month(spark, sf_dir):
    return A.kpis(_table(spark, sf_dir), by=["customer_segment", "ship_month"])


# --- C24 filtered view ------------------------------------------------------------

FILTER_START, FILTER_END, FILTER_CARRIERS = "1996-01-01", "1998-12-31", ("Nordfrakt", "Kestrel Parcel")


@register("filtered_view", lambda: _sql(
    "SELECT order_id, ship_date, carrier, CAST(freight_cost_eur AS DOUBLE) AS freight_cost_eur, is_billable "
    f"FROM shipments WHERE ship_date BETWEEN DATE '{FILTER_START}' AND DATE '{FILTER_END}' "
    f"AND carrier IN ({', '.join(O.q(c) for c in FILTER_CARRIERS)})"))
def q_filtered_view(spark, sf_dir):
    v = V.filter_view(_table(spark, sf_dir), FILTER_START, FILTER_END, FILTER_CARRIERS)
    return v.select("order_id", "ship_date", "carrier", F.col("freight_cost_eur").cast("double").alias("freight_cost_eur"),
                    "is_billable")


# --- A12 carrier totals, A3 book ----------------------------------------------------

def _totals_sql() -> str:
    bc = f"_bc AS (SELECT {CARRIER_SQL} FROM shipments WHERE carrier IS NOT NULL GROUP BY carrier)"
    return _sql(
        """SELECT carrier, false AS is_total, orders, billable_orders, round(spend, 2) AS spend,
  round(penalties, 2) AS penalties, on_time_pct FROM _bc
UNION ALL
SELECT 'Total', true, CAST(sum(orders) AS BIGINT), CAST(sum(billable_orders) AS BIGINT), round(sum(spend), 2),
  round(sum(penalties), 2), NULL FROM _bc""",
        bc,
    )


@register("carrier_totals", _totals_sql)
def q_carrier_totals(spark, sf_dir):
    return A.carrier_totals(_table(spark, sf_dir))


@register("book_cost_per_shipment", lambda: _sql(
    f"SELECT {msum('CASE WHEN is_billable THEN freight_cost_eur END')} / "
    f"CAST(greatest(count_if(is_billable), 1) AS DOUBLE) AS book_cost_per_shipment FROM shipments"))
def q_book_cost(spark, sf_dir):
    return A.book_cost_per_shipment(_table(spark, sf_dir))


# --- A4/A5 trend --------------------------------------------------------------------

for _grain, _col in (("week", "ship_week"), ("month", "ship_month"), ("day", "ship_date")):
    def _mk(grain=_grain, col=_col):
        @register(f"trend_{grain}", lambda: _sql("SELECT * FROM _tr", *trend_sql_ctes("shipments", col, grain, "_tr")))
        def q_trend(spark, sf_dir):
            return A.trend(_table(spark, sf_dir), grain)
        return q_trend
    _mk()


# --- A6-A8 lane matrix, C25 preset ------------------------------------------------

def _matrix_sql(weeks: int | None) -> str:
    view = _preset_sql("_v", weeks)
    cells = f"""_cells AS (
  SELECT carrier, destination_country, {cnt()} AS shipments,
    CASE WHEN count(*) >= {K.MIN_LANE_SHIPMENTS} THEN {pct("count_if(is_on_time)", "count(*)")} END AS on_time_pct
  FROM _v WHERE NOT is_cancelled AND carrier IS NOT NULL AND destination_country IS NOT NULL
  GROUP BY carrier, destination_country)"""
    dest = """_dest AS (
  SELECT destination_country,
    CAST(row_number() OVER (ORDER BY avg(on_time_pct) ASC NULLS LAST, destination_country) AS INTEGER) AS destination_rank
  FROM _cells GROUP BY destination_country)"""
    return _sql(
        f"""SELECT carrier, destination_country, shipments, on_time_pct, destination_rank,
  CAST(100 AS DOUBLE) - on_time_pct AS late_pct, {carrier_rank_sql()} AS carrier_rank
FROM _cells JOIN _dest USING (destination_country)""",
        view, cells, dest,
    )


@register("lane_matrix", lambda: _matrix_sql(None))
def q_lane_matrix(spark, sf_dir):
    return A.lane_matrix(_table(spark, sf_dir))


@register("lane_matrix_4w", lambda: _matrix_sql(4))
def q_lane_matrix_4w(spark, sf_dir):
    return A.lane_matrix(V.preset_view(_table(spark, sf_dir), "4w"))


# --- A9 weekday effects, F2 signal, A16 evidence -------------------------------------

def regions_values() -> str:
    rows = []
    for i, (name, cs) in enumerate(K.REGIONS.items()):
        members = ", ".join(sorted(cs))
        for c in cs:
            rows.append(f"({O.q(name)}, {i}, {O.q(c)}, {O.q(members)})")
    return ("_reg AS (SELECT region, CAST(region_order AS INTEGER) AS region_order, destination_country, destinations "
            f"FROM (VALUES {', '.join(rows)}) t(region, region_order, destination_country, destinations))")


def effects_ctes(src: str = "shipments") -> list[str]:
    days = O.arr(K.WEEKDAYS_TESTED)
    m = K.MIN_LANE_SHIPMENTS
    return [
        regions_values(),
        f"""_cells AS (
  SELECT carrier, region, region_order, destinations, ship_weekday, count(*) AS n, sum(transit_days) AS t_sum,
    count(transit_days) AS t_n, count_if(is_late) AS late_n, {msum("late_penalty_eur")} AS penalties
  FROM {src} JOIN _reg USING (destination_country)
  WHERE NOT is_cancelled AND carrier IS NOT NULL
  GROUP BY carrier, region, region_order, destinations, ship_weekday)""",
        """_sc AS (
  SELECT *, sum(n) OVER w AS s_n, sum(t_sum) OVER w AS s_t_sum, sum(t_n) OVER w AS s_t_n, sum(late_n) OVER w AS s_late_n
  FROM _cells WINDOW w AS (PARTITION BY carrier, region))""",
        f"""_cand AS (
  SELECT *, CAST(s_t_sum - t_sum AS DOUBLE) / NULLIF(s_t_n - t_n, 0) AS _base,
    list_position({days}, ship_weekday) AS _day
  FROM _sc WHERE list_position({days}, ship_weekday) > 0 AND s_n >= {2 * m} AND n >= {m} AND s_n - n >= {m})""",
        """_eff AS (
  SELECT carrier, region, region_order, destinations, ship_weekday AS weekday, CAST(n AS BIGINT) AS shipments,
    CAST(s_n - n AS BIGINT) AS baseline_shipments,
    CAST(100 AS DOUBLE) * ((CAST(t_sum AS DOUBLE) / NULLIF(t_n, 0)) / _base - 1.0) AS transit_uplift_pct,
    CAST(100 AS DOUBLE) * CAST(late_n AS DOUBLE) / n AS late_pct,
    CAST(100 AS DOUBLE) * CAST(s_late_n - late_n AS DOUBLE) / (s_n - n) AS baseline_late_pct,
    penalties AS penalties_eur, _day
  FROM _cand WHERE _base IS NULL OR _base <> 0)""",
        """effects AS (
  SELECT * EXCLUDE (_rn, _day) FROM (
    SELECT *, row_number() OVER (PARTITION BY carrier, region ORDER BY transit_uplift_pct DESC, _day) AS _rn
    FROM _eff WHERE transit_uplift_pct IS NOT NULL) WHERE _rn = 1)""",
        f"""signal AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, late_pct - baseline_late_pct AS late_gap_pct,
      row_number() OVER (ORDER BY penalties_eur DESC, carrier, region_order) AS _rn
    FROM effects WHERE transit_uplift_pct >= {K.MIN_UPLIFT_PCT} AND late_pct - baseline_late_pct >= {K.MIN_LATE_GAP_PCT})
  WHERE _rn = 1)""",
    ]


@register("weekday_effects", lambda: _sql("SELECT * FROM effects", *effects_ctes()))
def q_weekday_effects(spark, sf_dir):
    return A.weekday_effects(_table(spark, sf_dir))


@register("weekday_signal", lambda: _sql("SELECT * FROM signal", *effects_ctes()))
def q_weekday_signal(spark, sf_dir):
    return A.weekday_signal(_table(spark, sf_dir))


def _evidence_sql() -> str:
    order = O.arr(K.WEEKDAYS)
    return _sql(
        f"""SELECT s.carrier, r.region, s.ship_weekday AS weekday, {cnt()} AS shipments,
  {pct("count_if(s.is_late)", "count(*)")} AS late_pct, avg(s.transit_days) AS transit_days,
  {msum("s.late_penalty_eur")} AS penalties, CAST(list_position({order}, s.ship_weekday) AS INTEGER) AS weekday_order
FROM shipments s JOIN _reg r USING (destination_country) JOIN (SELECT DISTINCT carrier, region FROM signal) g
  ON s.carrier = g.carrier AND r.region = g.region
WHERE NOT s.is_cancelled
GROUP BY s.carrier, r.region, s.ship_weekday""",
        *effects_ctes(),
    )


@register("weekday_evidence", _evidence_sql)
def q_weekday_evidence(spark, sf_dir):
    t = _table(spark, sf_dir)
    return A.weekday_evidence(t, A.weekday_signal(t))


# --- A10/A17 lanes, A13 composition ---------------------------------------------------

def lanes_ctes(src: str = "shipments", limit: int = 3) -> list[str]:
    return [
        f"""_lanes AS (
  SELECT carrier, destination_country, {cnt()} AS orders, {pct("count_if(is_late)", "count(*)")} AS late_pct,
    {msum("late_penalty_eur")} AS penalties
  FROM {src} WHERE NOT is_cancelled AND carrier IS NOT NULL AND destination_country IS NOT NULL
  GROUP BY carrier, destination_country HAVING count(*) >= {K.MIN_LANE_SHIPMENTS})""",
        f"""_book AS (SELECT {pct("count_if(is_late)", "count(*)")} AS book_late_pct FROM {src} WHERE NOT is_cancelled)""",
        f"""lanes AS (
  SELECT * FROM (
    SELECT _lanes.*, CAST(row_number() OVER (ORDER BY penalties DESC, carrier, destination_country) AS INTEGER) AS lane_rank,
      book_late_pct, late_pct - book_late_pct AS late_pct_above_book
    FROM _lanes, _book) WHERE lane_rank <= {limit})""",
    ]


@register("worst_lanes", lambda: _sql("SELECT * FROM lanes", *lanes_ctes()))
def q_worst_lanes(spark, sf_dir):
    return A.worst_lanes(_table(spark, sf_dir), limit=3)


def _composition_sql() -> str:
    return _sql(
        """SELECT carrier, CAST(penalties AS DOUBLE) AS penalties, CAST(_rn AS INTEGER) AS position FROM _r
WHERE _rn <= 3 AND penalties > 0
UNION ALL
SELECT 'Other', CAST(sum(penalties) AS DOUBLE), 4 FROM _r WHERE _rn > 3 HAVING sum(penalties) > 0""",
        """_p AS (SELECT carrier, coalesce(sum(late_penalty_eur), 0) AS penalties FROM shipments
  WHERE NOT is_cancelled AND carrier IS NOT NULL GROUP BY carrier)""",
        "_r AS (SELECT *, row_number() OVER (ORDER BY penalties DESC, carrier) AS _rn FROM _p)",
    )


@register("composition", _composition_sql)
def q_composition(spark, sf_dir):
    return A.composition(_table(spark, sf_dir))


# --- C26/A14 KPI change, A15 last 13 weeks, A18 bounds ---------------------------------

def _change_sql(window: str | None = None) -> str:
    """``window``: SQL of the two bounds _st and _en; else the last 13 weeks."""
    last13 = "SELECT greatest(min(ship_date), max(ship_date) - 91) AS _st, max(ship_date) AS _en FROM shipments"
    w = ("_w AS (SELECT _st AS st, _en AS en, _st - CAST(_en - _st + 1 AS INTEGER) AS pst, _st - 1 AS pen, "
         f"CAST(_en - _st + 1 AS INTEGER) AS prior_days FROM ({window or last13}))")
    lab = ("_lab AS (SELECT s.*, CASE WHEN ship_date BETWEEN st AND en THEN 'current' "
           "WHEN ship_date BETWEEN pst AND pen THEN 'prior' END AS win, prior_days FROM shipments s, _w)")
    per = f"_per AS (SELECT win, max(prior_days) AS prior_days, {KPI_SQL} FROM _lab WHERE win IS NOT NULL GROUP BY win)"
    both = ("_both AS (SELECT c.prior_days, coalesce(p.orders, 0) >= " + str(K.MIN_PRIOR_SHIPMENTS) + " AS has_prior, "
            "c.total_spend AS c_spend, p.total_spend AS p_spend, c.on_time_pct AS c_on_time, p.on_time_pct AS p_on_time, "
            "c.avg_delay AS c_avg_delay, p.avg_delay AS p_avg_delay, CAST(c.orders AS DOUBLE) AS c_orders, "
            "CAST(p.orders AS DOUBLE) AS p_orders "
            "FROM (SELECT * FROM _per WHERE win = 'current') c LEFT JOIN (SELECT * FROM _per WHERE win = 'prior') p ON true)")
    parts = []
    for name, kind in (("spend", "pct"), ("on_time", "pts"), ("avg_delay", "days"), ("orders", "pct")):
        prior = f"CASE WHEN has_prior THEN p_{name} END"
        if kind == "pct":
            delta = f"CAST(100 AS DOUBLE) * (c_{name} / NULLIF({prior}, 0) - 1.0)"
            direction = (f"CASE WHEN {delta} IS NULL THEN NULL WHEN c_{name} > {prior} THEN 'up' "
                         f"WHEN c_{name} < {prior} THEN 'down' ELSE 'flat' END")
        else:
            delta = f"c_{name} - {prior}"
            b = K.KPI_DEAD_BAND
            direction = (f"CASE WHEN {delta} IS NULL THEN NULL WHEN {delta} > {b} THEN 'up' "
                         f"WHEN {delta} < -{b} THEN 'down' ELSE 'flat' END")
        parts.append(f"SELECT {O.q(name)} AS kpi, c_{name} AS current, {prior} AS prior, {delta} AS delta, "
                     f"{direction} AS direction, prior_days, {O.q(kind)} AS kind FROM _both")
    return _sql("\nUNION ALL\n".join(parts), w, lab, per, both)


@register("kpi_change", _change_sql)
def q_kpi_change(spark, sf_dir):
    t = _table(spark, sf_dir)
    return A.kpi_change(V.with_prior(t, V.preset_window(t, "13w")))


def _last13_sql() -> str:
    tr = trend_sql_ctes("shipments", "ship_week", "week", "_tr")
    last = "_last AS (SELECT * FROM _tr ORDER BY period DESC LIMIT 13)"
    long = "_long AS (" + " UNION ALL ".join(
        f"SELECT period, {O.q(k)} AS kpi, CAST({c} AS DOUBLE) AS value FROM _last"
        for k, c in (("spend", "spend"), ("on_time", "on_time_pct"), ("avg_delay", "avg_delay"), ("orders", "orders"))
    ) + ")"
    return _sql(
        """SELECT period, kpi, value, points FROM (
  SELECT period, kpi, value, CAST(count(*) OVER (PARTITION BY kpi) AS BIGINT) AS points FROM (
    SELECT period, kpi, CAST(value AS DOUBLE) AS value FROM _long WHERE value IS NOT NULL))
WHERE points >= 3""",
        *tr, last, long,
    )


@register("kpi_last13", _last13_sql)
def q_kpi_last13(spark, sf_dir):
    return A.kpi_last_weeks(_table(spark, sf_dir))


def _bounds_sql() -> str:
    def week(x):
        return f"'W' || lpad(CAST(weekofyear({x}) AS VARCHAR), 2, '0') || ' ' || CAST(isoyear({x}) AS VARCHAR)"

    return _sql(
        f"""SELECT first_date, last_date, {week('first_date')} || ' to ' || {week('last_date')} AS period_label,
  strftime(first_date, '%Y-%m-%d') || ' to ' || strftime(last_date, '%Y-%m-%d') AS iso_range
FROM (SELECT min(ship_date) AS first_date, max(ship_date) AS last_date FROM shipments)"""
    )


@register("period_bounds", _bounds_sql)
def q_period_bounds(spark, sf_dir):
    b = V.bounds(_table(spark, sf_dir))
    return b.select("first_date", "last_date", X.fmt_week_range("first_date", "last_date").alias("period_label"),
                    X.fmt_iso_range("first_date", "last_date").alias("iso_range"))
