"""One stored, additive cube under every view.

A cell holds the counts and sums of all populations for one day x carrier x
destination x service x segment. Each measure is a count or a sum, and dates
merge by min and max, so any date range, carrier list or slice is a filter and a
sum over cells, exact to the cent: the shipments are read once, when the
cube is built, however many views follow.

``measures`` gives the same aggregate expressions over shipments and over
cells, so every function of ``aggregates`` and ``findings`` takes either.
The cube has at most one row a combination that occurs; it is kept in date
order, so a date range skips row groups by their statistics.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.session import jit_sized

# what a cell stands for; the calendar columns depend on the day
DIMENSIONS = ["ship_date", "ship_weekday", "ship_week", "ship_month", "carrier", "destination_country", "service_level",
              "customer_segment"]
COUNTS = ["n_all", "n_billable", "n_active", "n_cancelled", "n_outlier", "n_excluded", "n_on_time", "n_late", "t_n"]
SUMS = ["spend", "delay_sum", "penalties", "t_sum"]


def is_cube(df: DataFrame) -> bool:
    return "n_all" in df.columns


def active_rows(df: DataFrame) -> DataFrame:
    """Shipments that are not cancelled, or the cells that hold one."""
    return df.filter(F.col("n_active") > 0 if is_cube(df) else ~F.col("is_cancelled"))


def measures(df: DataFrame) -> dict[str, Column]:
    """Aggregate expressions by measure name. Counts are never null; a sum over
    nothing is. ``first_date`` and ``last_date`` are ends of the days."""
    dates = {"first_date": F.min("first_date" if "first_date" in df.columns else "ship_date"),
             "last_date": F.max("last_date" if "last_date" in df.columns else "ship_date")}
    if is_cube(df):
        return {**{c: F.coalesce(F.sum(c), F.lit(0).cast("long")) for c in COUNTS}, **{c: F.sum(c) for c in SUMS}, **dates}
    act, late = ~F.col("is_cancelled"), F.col("is_late") & ~F.col("is_cancelled")
    return {
        "n_all": F.count(F.lit(1)),
        "n_billable": F.count_if(F.col("is_billable")),
        "n_active": F.count_if(act),
        "n_cancelled": F.count_if(F.col("is_cancelled")),
        "n_outlier": F.count_if(F.col("cost_is_outlier")),
        "n_excluded": F.count_if(F.col("is_cancelled") | F.col("cost_is_outlier")),
        "n_on_time": F.count_if(F.col("is_on_time") & act),
        "n_late": F.count_if(late),
        "t_n": F.count(F.when(act, F.col("transit_days"))),
        "spend": F.sum(F.when(F.col("is_billable"), F.col("freight_cost_eur"))),
        "delay_sum": F.sum(F.when(late, F.col("delay_days"))),
        "penalties": F.sum(F.when(act, F.col("late_penalty_eur"))),
        "t_sum": F.sum(F.when(act, F.col("transit_days"))),
        **dates,
    }


def grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """All measures per group of ``keys``: again a cube, at a coarser grain."""
    m = measures(df)
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in m.items()])


def build_cube(shipments: DataFrame) -> DataFrame:
    """The cube of a processed table: one partial aggregate (hot cells are
    combined map-side) and one shuffle of cells."""
    return grouped(shipments, DIMENSIONS).drop("first_date", "last_date")


def write_cube(shipments: DataFrame, path: str) -> None:
    """Store the cube beside its table, in date order over all files."""
    with jit_sized(shipments.sparkSession):
        build_cube(shipments).repartitionByRange("ship_date").sortWithinPartitions("ship_date").write.mode("overwrite").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    cube = spark.read.parquet(path)
    lost = [c for c in (*DIMENSIONS, *COUNTS, *SUMS) if c not in cube.columns]
    if lost:
        raise ValueError(f"{path} is no cube of shipments: it lacks {', '.join(lost)}")
    return cube


class View:
    """Everything a reader of one date range and carrier list sees, from the
    cube alone. Outputs are made when asked for and kept; ``by`` gives each of
    them per slice (service level, segment, month ...) in the same job. The
    findings share one small cube, written once (``stage``)."""

    def __init__(self, cube: DataFrame, start, end, carriers=(), by=None, grain: str = "week", stage: bool = True):
        from shipledger.operators import aggregates, findings, views

        self._a, self._f, self._v = aggregates, findings, views
        self.cube, self.carrier_list, self.by, self.grain = cube, tuple(carriers), by, grain
        self.window = views.window_dates(start, end)
        self.prior_days = views.window_days(start, end)
        self.cells = views.filter_view(cube, *self.window, self.carrier_list)
        self.facts = findings.Facts(self.cells, by, stage=stage)

    @cached_property
    def bounds(self) -> DataFrame:
        return self._v.bounds(self.cells, self.by)

    @cached_property
    def kpis(self) -> DataFrame:
        return self._a.kpis(self.cells, self.by)

    @cached_property
    def change(self) -> DataFrame:
        """Against the window of equal length before this one."""
        return self._a.kpi_change(self._v.with_prior(self.cube, self.window, self.carrier_list), by=self.by)

    @cached_property
    def carriers(self) -> DataFrame:
        return self._a.spend_by_carrier(self.cells, self.by)

    @cached_property
    def totals(self) -> DataFrame:
        return self._a.carrier_totals(self.cells, self.by)

    @cached_property
    def trend(self) -> DataFrame:
        return self._a.trend(self.cells, self.grain, by=self.by)

    @cached_property
    def last_weeks(self) -> DataFrame:
        return self._a.kpi_last_weeks(self.cells, by=self.by)

    @cached_property
    def matrix(self) -> DataFrame:
        return self._a.lane_matrix(self.cells, by=self.by)

    @cached_property
    def weekdays(self) -> DataFrame:
        return self._a.weekday_effects(self.cells, by=self.by)

    @cached_property
    def lanes(self) -> DataFrame:
        return self._a.worst_lanes(self.cells, by=self.by)

    @cached_property
    def composition(self) -> DataFrame:
        return self._a.composition(self.cells, by=self.by)

    @cached_property
    def findings(self) -> DataFrame:
        return self._f.findings(self.cells, facts=self.facts)

    @cached_property
    def records(self) -> DataFrame:
        return self._f.records(self.cells, facts=self.facts)

    @cached_property
    def cites(self) -> DataFrame:
        return self._f.finding_cites(self.cells, facts=self.facts)

    @cached_property
    def evidence(self) -> DataFrame:
        return self._f.evidence(self.cells, facts=self.facts)

    @cached_property
    def summary(self) -> DataFrame:
        return self._f.executive_summary(self.cells, facts=self.facts)

    @cached_property
    def brief(self) -> DataFrame:
        return self._f.brief(self.cells, facts=self.facts)

    @cached_property
    def brief_audit(self) -> DataFrame:
        return self._f.brief_audit(self.cells, facts=self.facts)


def build_view(cube: DataFrame, start, end, carriers=(), by=None, grain: str = "week", stage: bool = True) -> View:
    """All outputs for one filter (see ``View``)."""
    return View(cube, start, end, carriers, by, grain, stage)
