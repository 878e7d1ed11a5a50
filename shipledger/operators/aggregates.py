"""Aggregates over a view.

Populations: *all* = every row in view, *active* = not cancelled, *billable*
= active and not a cost outlier. Every function states which one it uses and
computes all populations in ONE conditional aggregation instead of one
group-by per population plus joins. Windows only ever run over these small
aggregates, never over shipment rows. ``df`` is a table of shipments or a cube
of them (``cube.build_cube``): the measures are the same expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipledger import constants as K
from shipledger.operators.cube import active_rows, measures


def ratio_pct(k: Column, n: Column) -> Column:
    """100 * (k / n), null when n is 0. Written as a mean times 100."""
    return F.lit(100.0) * (k.cast("double") / F.when(n != 0, n.cast("double")))


def money(total: Column) -> Column:
    """A sum of money, 0 over nothing."""
    return F.coalesce(total, F.lit(0).cast("decimal(18,2)"))


def money_sum(c: Column) -> Column:
    return money(F.sum(c))


def mean(total: Column, n: Column) -> Column:
    """A mean from a sum and a count, null over nothing."""
    return total.cast("double") / F.when(n != 0, n)


def carrier_rank(order: list[str] | None = None) -> Column:
    """Position in the fixed carrier order; unknown carriers after them."""
    order = K.CARRIER_ORDER if order is None else order
    pairs = []
    for i, c in enumerate(order):
        pairs += [F.lit(c), F.lit(i)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("carrier")), F.lit(len(order)))


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def join_on(a: DataFrame, b: DataFrame, slices: list[str], also: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join on slice keys, where null is a slice like any other, and on the
    columns of ``also``, where null matches nothing. Keys come from ``a``; with
    no key at all, ``b`` is a one-row frame."""
    also = also or []
    other = b.select(*[F.col(c).alias(f"_right_{c}") if c in (*slices, *also) else F.col(c) for c in b.columns])
    match = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in slices] + [
        F.col(c) == F.col(f"_right_{c}") for c in also]
    out = a.join(other, reduce(lambda x, y: x & y, match) if match else F.lit(True), how)
    return out.drop(*[f"_right_{c}" for c in (*slices, *also)])


# ---------------------------------------------------------------------------
# A1 KPIs
# ---------------------------------------------------------------------------

def kpi_columns(df: DataFrame) -> list[Column]:
    m = measures(df)
    return [
        money(m["spend"]).cast("double").alias("total_spend"),
        m["n_all"].alias("orders"),
        m["n_billable"].alias("billable_orders"),
        m["n_active"].alias("active_orders"),
        m["n_cancelled"].alias("cancelled_orders"),
        m["n_outlier"].alias("outlier_orders"),
        m["n_excluded"].alias("excluded_from_spend"),
        F.coalesce(ratio_pct(m["n_on_time"], m["n_active"]), F.lit(0.0)).alias("on_time_pct"),
        F.coalesce(mean(m["delay_sum"], m["n_late"]), F.lit(0.0)).alias("avg_delay"),
        m["n_late"].alias("late_orders"),
        money(m["penalties"]).cast("double").alias("penalties"),
    ]


def kpis(df: DataFrame, by=None) -> DataFrame:
    """A1: the 11 headline measures; one row, or one row per slice of ``by``."""
    keys = _keys(by)
    if keys:
        return df.groupBy(*keys).agg(*kpi_columns(df))
    return df.agg(*kpi_columns(df))


# ---------------------------------------------------------------------------
# A2, A3, A11 carriers
# ---------------------------------------------------------------------------

def spend_by_carrier(df: DataFrame, by=None) -> DataFrame:
    """A2 (+A3 cost per billable shipment, +A11 penalties). ``orders`` counts
    all rows, ``spend``/``billable_orders`` the billable ones, ``on_time_pct``
    the active ones (null when none). Carriers with no billable row stay, at
    zero spend. Rows with no carrier are not a carrier and are left out."""
    keys = _keys(by)
    m = measures(df)
    spend = money(m["spend"])
    out = (
        df.filter(F.col("carrier").isNotNull())
        .groupBy(*keys, "carrier")
        .agg(
            spend.cast("double").alias("spend"),
            m["n_all"].alias("orders"),
            m["n_billable"].alias("billable_orders"),
            ratio_pct(m["n_on_time"], m["n_active"]).alias("on_time_pct"),
            money(m["penalties"]).cast("double").alias("penalties"),
            mean(spend, m["n_billable"]).alias("cost_per_shipment"),
        )
        .withColumn("carrier_rank", carrier_rank())
    )
    return out


def book_cost_per_shipment(df: DataFrame, by=None) -> DataFrame:
    """A3 reference line: billable spend over max(billable orders, 1)."""
    m = measures(df)
    cost = money(m["spend"]).cast("double") / F.greatest(m["n_billable"], F.lit(1))
    return df.groupBy(*_keys(by)).agg(cost.alias("book_cost_per_shipment"))


def carrier_totals(df: DataFrame, by=None) -> DataFrame:
    """The carrier table with a totals row (``rollup`` over the small
    per-carrier aggregate, not over shipments), per slice of ``by``."""
    keys = _keys(by)
    total = (F.grouping("carrier") == 1).alias("is_total")
    out = spend_by_carrier(df, by).rollup(*keys, "carrier").agg(
        F.sum("orders").alias("orders"),
        F.sum("billable_orders").alias("billable_orders"),
        F.sum("spend").alias("spend"),
        F.sum("penalties").alias("penalties"),
        F.max("on_time_pct").alias("_ot"),
        total,
        F.grouping(keys[-1]).alias("_whole") if keys else F.lit(0).alias("_whole"),
    )
    return out.filter(F.col("_whole") == 0).select(  # with slices, a total over them all is no slice's
        *keys, F.when(F.col("is_total"), F.lit("Total")).otherwise(F.col("carrier")).alias("carrier"), "is_total",
        "orders", "billable_orders",
        F.round("spend", 2).alias("spend"),
        F.round("penalties", 2).alias("penalties"),
        F.when(~F.col("is_total"), F.col("_ot")).alias("on_time_pct"),
    )


# ---------------------------------------------------------------------------
# A4, A5 trend
# ---------------------------------------------------------------------------

_GRAIN = {"day": "ship_date", "week": "ship_week", "month": "ship_month"}


def trend(df: DataFrame, grain: str = "week", trim: bool = True, by=None) -> DataFrame:
    """A4 + A5: one row per period with an active shipment; clipped edge
    periods dropped (not for days, only with >= 4 periods), per slice of ``by``.

    One pass over the shipments: each period also carries the first and last
    ship date of all its rows, so the view's bounds, the period count and the
    edge periods come from windows over the (small, one row per period)
    aggregate instead of further scans of the table."""
    col, keys, m = _GRAIN[grain], _keys(by), measures(df)
    names = ["spend", "on_time_pct", "orders", "late_orders", "penalties", "avg_delay"]
    all_periods = df.groupBy(*keys, F.col(col).alias("period")).agg(
        money(m["spend"]).cast("double").alias("spend"),
        ratio_pct(m["n_on_time"], m["n_active"]).alias("on_time_pct"),
        m["n_active"].alias("orders"),
        m["n_late"].alias("late_orders"),
        money(m["penalties"]).cast("double").alias("penalties"),
        mean(m["delay_sum"], m["n_late"]).alias("avg_delay"),
        m["first_date"].alias("_dmin"),
        m["last_date"].alias("_dmax"),
    )
    if grain == "day" or not trim:
        return all_periods.filter(F.col("orders") > 0).select(*keys, "period", *names)
    every = Window.partitionBy(*keys)  # over the period aggregate only (bounded by the number of periods)
    per = (
        all_periods.withColumns({"_lo": F.min("_dmin").over(every), "_hi": F.max("_dmax").over(every)})
        .filter(F.col("orders") > 0)
        .withColumns({"_n": F.count(F.lit(1)).over(every), "_first": F.min("period").over(every),
                      "_last": F.max("period").over(every)})
    )
    last_end = F.date_add(F.col("_last"), 6) if grain == "week" else F.last_day(F.col("_last"))
    drop_first = (F.col("_n") >= 4) & (F.col("_first") < F.col("_lo"))
    remaining = F.col("_n") - drop_first.cast("int")
    drop_last = (F.col("_n") >= 4) & (last_end > F.col("_hi")) & (remaining > 2)
    keep = ~((F.col("period") == F.col("_first")) & drop_first) & ~((F.col("period") == F.col("_last")) & drop_last)
    return per.filter(keep).select(*keys, "period", *names)


# ---------------------------------------------------------------------------
# A6, A7, A8 carrier x destination matrix
# ---------------------------------------------------------------------------

def lane_matrix(df: DataFrame, min_shipments: int = K.MIN_LANE_SHIPMENTS, by=None) -> DataFrame:
    """A6-A8 in long form: one row per (carrier, destination) cell of active
    shipments, on-time % masked below ``min_shipments``, late % = 100 - it,
    carrier rank (fixed order) and destination rank (worst mean first), per
    slice of ``by``."""
    keys, m = _keys(by), measures(df)
    active = active_rows(df).filter(F.col("carrier").isNotNull() & F.col("destination_country").isNotNull())
    cells = active.groupBy(*keys, "carrier", "destination_country").agg(
        m["n_active"].alias("shipments"), ratio_pct(m["n_on_time"], m["n_active"]).alias("_rate"))
    cells = cells.withColumn(
        "on_time_pct", F.when(F.col("shipments") >= min_shipments, F.col("_rate"))
    ).drop("_rate")
    dest = cells.groupBy(*keys, "destination_country").agg(F.avg("on_time_pct").alias("_mean"))
    worst = Window.partitionBy(*keys).orderBy(F.col("_mean").asc_nulls_last(), F.col("destination_country"))
    dest = dest.withColumn("destination_rank", F.row_number().over(worst)).drop("_mean")
    return (
        join_on(cells, dest, keys, ["destination_country"])  # destinations are free text: the optimiser sizes this
        .withColumn("late_pct", F.lit(100.0) - F.col("on_time_pct"))
        .withColumn("carrier_rank", carrier_rank())
    )


def lane_matrix_wide(df: DataFrame, value: str = "late_pct", min_shipments: int = K.MIN_LANE_SHIPMENTS) -> DataFrame:
    """The matrix pivoted to one column per destination, worst first."""
    long = lane_matrix(df, min_shipments)
    order = [r[0] for r in long.select("destination_country", "destination_rank").distinct()
             .orderBy("destination_rank").collect()]
    fill = {c: 0 for c in order} if value == "shipments" else None
    wide = long.groupBy("carrier", "carrier_rank").pivot("destination_country", order).agg(F.first(value))
    return wide.fillna(fill) if fill else wide


# ---------------------------------------------------------------------------
# A9 weekday effects, A16 weekday evidence
# ---------------------------------------------------------------------------

def regions_frame(spark, regions: dict | None = None) -> DataFrame:
    """(region, region_order, destination_country, destinations): one row per
    listed country (a country may sit in several regions). Built from a
    literal on the JVM side, so no rows travel from Python."""
    regions = K.REGIONS if regions is None else regions
    rows = [
        F.struct(F.lit(name).alias("region"), F.lit(i).alias("region_order"), F.lit(c).alias("destination_country"),
                 F.lit(", ".join(sorted(cs))).alias("destinations"))
        for i, (name, cs) in enumerate(regions.items()) for c in cs
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def weekday_cells(df: DataFrame, regions: dict | None = None, by=None) -> DataFrame:
    """Active shipments per (slice, carrier, region, weekday): n, transit sum
    and count, late count, penalties. Rows are exploded onto every region
    that lists their destination (a broadcast of the listed countries)."""
    keys, m = _keys(by), measures(df)
    reg = F.broadcast(regions_frame(df.sparkSession, regions))  # size = listed countries
    active = active_rows(df).filter(F.col("carrier").isNotNull()).join(reg, "destination_country")
    return active.groupBy(*keys, "carrier", "region", "region_order", "destinations", "ship_weekday").agg(
        m["n_active"].alias("n"),
        m["t_sum"].alias("t_sum"),
        m["t_n"].alias("t_n"),
        m["n_late"].alias("late_n"),
        money(m["penalties"]).cast("double").alias("penalties"),
    )


def effects_from_cells(cells: DataFrame, min_shipments: int = K.MIN_LANE_SHIPMENTS, by=None) -> DataFrame:
    """The scope arithmetic of A9 over (carrier, region, weekday) cells: each
    tested weekday against the scope total minus the cell; strongest uplift
    per scope, earliest day on ties. The scope totals are a window over the
    small cell aggregate, never over rows."""
    keys = _keys(by)
    scope = Window.partitionBy(*keys, "carrier", "region")
    for c in ("n", "t_sum", "t_n", "late_n"):
        cells = cells.withColumn(f"s_{c}", F.sum(c).over(scope))
    day_idx = F.array_position(F.array(*[F.lit(d) for d in K.WEEKDAYS_TESTED]), F.col("ship_weekday"))
    rest_n = F.col("s_n") - F.col("n")
    rest_tn = F.col("s_t_n") - F.col("t_n")
    base = (F.col("s_t_sum") - F.col("t_sum")).cast("double") / F.when(rest_tn != 0, rest_tn)
    subject = F.col("t_sum").cast("double") / F.when(F.col("t_n") != 0, F.col("t_n"))
    cand = (
        cells.withColumn("_day", day_idx)
        .filter(
            (F.col("_day") > 0)
            & (F.col("s_n") >= 2 * min_shipments)
            & (F.col("n") >= min_shipments)
            & (rest_n >= min_shipments)
        )
        .withColumn("_base", base)
        .filter(F.col("_base").isNull() | (F.col("_base") != 0))
        .select(
            *keys, "carrier", "region", "region_order", "destinations",
            F.col("ship_weekday").alias("weekday"),
            F.col("n").alias("shipments"),
            rest_n.alias("baseline_shipments"),
            (F.lit(100.0) * (subject / F.col("_base") - F.lit(1.0))).alias("transit_uplift_pct"),
            (F.lit(100.0) * F.col("late_n").cast("double") / F.col("n")).alias("late_pct"),
            (F.lit(100.0) * (F.col("s_late_n") - F.col("late_n")).cast("double") / rest_n).alias("baseline_late_pct"),
            "penalties",
            "_day",
        )
        .filter(F.col("transit_uplift_pct").isNotNull())
    )
    best = Window.partitionBy(*keys, "carrier", "region").orderBy(F.col("transit_uplift_pct").desc(), F.col("_day"))
    return (
        cand.withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") == 1)
        .drop("_rn", "_day")
        .withColumnRenamed("penalties", "penalties_eur")
    )


def weekday_effects(df: DataFrame, regions: dict | None = None,
                    min_shipments: int = K.MIN_LANE_SHIPMENTS, by=None) -> DataFrame:
    """Per carrier and region, each tested weekday's mean transit and late
    rate against the other days of the same scope (scope total minus the
    cell), keeping the strongest uplift (earliest day on ties)."""
    return effects_from_cells(weekday_cells(df, regions, by), min_shipments, by)


def signal_from_effects(eff: DataFrame, min_uplift: float = K.MIN_UPLIFT_PCT, min_gap: float = K.MIN_LATE_GAP_PCT,
                        by=None) -> DataFrame:
    keys = _keys(by)
    eff = eff.withColumn("late_gap_pct", F.col("late_pct") - F.col("baseline_late_pct"))
    cand = eff.filter((F.col("transit_uplift_pct") >= min_uplift) & (F.col("late_gap_pct") >= min_gap))
    w = Window.partitionBy(*keys).orderBy(F.col("penalties_eur").desc(), F.col("carrier"), F.col("region_order"))
    return cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def weekday_signal(df: DataFrame, regions: dict | None = None, min_uplift: float = K.MIN_UPLIFT_PCT,
                   min_gap: float = K.MIN_LATE_GAP_PCT, by=None) -> DataFrame:
    """F2 detection: effects with uplift >= 12 % and a late gap >= 8 points;
    the one with the most penalties (carrier A-Z, then region order, on ties).
    At most one row (per slice)."""
    return signal_from_effects(weekday_effects(df, regions, by=by), min_uplift, min_gap, by)


def weekday_evidence(df: DataFrame, scope: DataFrame, regions: dict | None = None, by=None) -> DataFrame:
    """For each (carrier, region) in ``scope`` (e.g. the detected signal),
    shipments, late %, mean transit and penalties per weekday, Mon-Sun."""
    keys = _keys(by)
    order = F.array_position(F.array(*[F.lit(d) for d in K.WEEKDAYS]), F.col("weekday"))
    cells = weekday_cells(df, regions, by)  # small: the scope is joined to the aggregate, not to the rows
    return join_on(cells, scope.select(*keys, "carrier", "region").distinct(), keys, ["carrier", "region"]).select(
        *keys, "carrier", "region", F.col("ship_weekday").alias("weekday"), F.col("n").alias("shipments"),
        ratio_pct(F.col("late_n"), F.col("n")).alias("late_pct"),
        (F.col("t_sum").cast("double") / F.when(F.col("t_n") != 0, F.col("t_n"))).alias("transit_days"),
        "penalties",
    ).withColumn("weekday_order", order.cast("int"))


# ---------------------------------------------------------------------------
# A10, A17 lanes; A13 composition
# ---------------------------------------------------------------------------

def worst_lanes(df: DataFrame, limit: int = 3, min_shipments: int = K.MIN_LANE_SHIPMENTS, by=None) -> DataFrame:
    """A10 (+A17): lanes of >= 8 active shipments ranked by penalties (top
    ``limit``, per slice of ``by``), with the excess over the book late rate.

    Active rows are aggregated per carrier x destination with null keys kept;
    the book rate is a window over those cells, so the table is read once."""
    keys, m = _keys(by), measures(df)
    cells = active_rows(df).groupBy(*keys, "carrier", "destination_country").agg(
        m["n_active"].alias("orders"), m["n_late"].alias("_late"), money(m["penalties"]).cast("double").alias("penalties"))
    book = Window.partitionBy(*keys)  # over cells: carriers x destinations of a slice
    lanes = cells.withColumn("book_late_pct", ratio_pct(F.sum("_late").over(book), F.sum("orders").over(book))).filter(
        F.col("carrier").isNotNull() & F.col("destination_country").isNotNull() & (F.col("orders") >= min_shipments))
    order = book.orderBy(F.col("penalties").desc(), F.col("carrier"), F.col("destination_country"))
    return lanes.withColumn("lane_rank", F.row_number().over(order)).filter(F.col("lane_rank") <= limit).select(
        *keys, "carrier", "destination_country", "orders", ratio_pct(F.col("_late"), F.col("orders")).alias("late_pct"),
        "penalties", "lane_rank", "book_late_pct",
        (ratio_pct(F.col("_late"), F.col("orders")) - F.col("book_late_pct")).alias("late_pct_above_book"),
    )


def composition(df: DataFrame, top: int = 3, by=None) -> DataFrame:
    """Penalties of the top three carriers (when > 0) and the rest as
    ``Other`` (when > 0), per slice of ``by``."""
    keys = _keys(by)
    pen = active_rows(df).filter(F.col("carrier").isNotNull()).groupBy(*keys, "carrier").agg(
        money(measures(df)["penalties"]).alias("penalties"))
    w = Window.partitionBy(*keys).orderBy(F.col("penalties").desc(), F.col("carrier"))
    ranked = pen.withColumn("_rn", F.row_number().over(w))
    named = ranked.filter((F.col("_rn") <= top) & (F.col("penalties") > 0)).select(
        *keys, "carrier", F.col("penalties").cast("double").alias("penalties"), F.col("_rn").alias("position")
    )
    other = (
        ranked.filter(F.col("_rn") > top)
        .groupBy(*keys)
        .agg(F.sum("penalties").alias("penalties"))
        .filter(F.col("penalties") > 0)
        .select(*keys, F.lit("Other").alias("carrier"), F.col("penalties").cast("double").alias("penalties"),
                F.lit(top + 1).alias("position"))
    )
    return named.unionByName(other)


# ---------------------------------------------------------------------------
# A14 KPI change, A15 sparkline values
# ---------------------------------------------------------------------------

def kpi_change(labelled: DataFrame, min_prior: int = K.MIN_PRIOR_SHIPMENTS, band: float = K.KPI_DEAD_BAND,
               by=None) -> DataFrame:
    """Current window against the prior one (``views.with_prior``), one
    row per KPI: relative % for spend and orders, points for on-time, days
    for delay; direction up / down / flat. No comparison when the prior
    window holds fewer than ``min_prior`` shipments or the base is 0. Per
    slice of ``by`` that has shipments in the current window."""
    keys = _keys(by)
    per = labelled.groupBy(*keys, "window").agg(*kpi_columns(labelled), F.max("prior_days").alias("prior_days"))
    names = [c for c in per.columns if c not in keys]
    cur = per.filter(F.col("window") == "current").select(*keys, *[F.col(c).alias("c_" + c) for c in names])
    pri = per.filter(F.col("window") == "prior").select(*keys, *[F.col(c).alias("p_" + c) for c in names])
    both = join_on(cur, pri, keys, how="left")  # at most one row each a slice
    stacked = both.select(
        *keys,
        F.col("c_prior_days").alias("prior_days"),
        (F.coalesce(F.col("p_orders"), F.lit(0)) >= min_prior).alias("has_prior"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("kpi"), F.lit(kind).alias("kind"),
                        F.col("c_" + col).cast("double").alias("current"),
                        F.col("p_" + col).cast("double").alias("prior"),
                    )
                    for name, col, kind in (
                        ("spend", "total_spend", "pct"),
                        ("on_time", "on_time_pct", "pts"),
                        ("avg_delay", "avg_delay", "days"),
                        ("orders", "orders", "pct"),
                    )
                ]
            )
        ),
    )
    prior = F.when(F.col("has_prior"), F.col("prior"))
    rel = F.lit(100.0) * (F.col("current") / F.when(prior != 0, prior) - F.lit(1.0))
    diff = F.col("current") - prior
    delta = F.when(F.col("kind") == "pct", rel).otherwise(diff)
    direction = (
        F.when(delta.isNull(), F.lit(None).cast("string"))
        .when(F.col("kind") == "pct",
              F.when(F.col("current") > prior, "up").when(F.col("current") < prior, "down").otherwise("flat"))
        .when(diff > band, "up").when(diff < -band, "down").otherwise("flat")
    )
    return stacked.select(
        *keys, "kpi", "current", prior.alias("prior"), delta.alias("delta"), direction.alias("direction"),
        "prior_days", "kind",
    )


def kpi_last_weeks(df: DataFrame, weeks: int = K.SPARKLINE_WEEKS, min_points: int = K.SPARKLINE_MIN_POINTS,
                   by=None) -> DataFrame:
    """The last ``weeks`` weekly values of spend, on-time, delay and
    orders, per KPI (and slice of ``by``), omitted when fewer than ``min_points`` are
    present."""
    keys = _keys(by)
    newest = Window.partitionBy(*keys).orderBy(F.col("period").desc())
    last = trend(df, "week", by=by).withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= weeks)
    long = last.select(
        *keys, "period",
        F.inline(
            F.array(
                F.struct(F.lit("spend").alias("kpi"), F.col("spend").cast("double").alias("value")),
                F.struct(F.lit("on_time").alias("kpi"), F.col("on_time_pct").cast("double").alias("value")),
                F.struct(F.lit("avg_delay").alias("kpi"), F.col("avg_delay").cast("double").alias("value")),
                F.struct(F.lit("orders").alias("kpi"), F.col("orders").cast("double").alias("value")),
            )
        ),
    ).filter(F.col("value").isNotNull())
    n = Window.partitionBy(*keys, "kpi")
    return long.withColumn("points", F.count(F.lit(1)).over(n)).filter(F.col("points") >= min_points)
