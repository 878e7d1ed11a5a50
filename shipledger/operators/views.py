"""Views over the processed table: date/carrier filters, period presets and
the prior comparison window (C24-C26). Filters are plain predicates on
``ship_date`` so they reach the Parquet scan; a derived ``ship_month`` bound
is added so month-partitioned tables prune whole directories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESET_WEEKS = {"all": None, "13w": 13, "4w": 4}


def _date(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, (dt.date, dt.datetime)):
        v = v.isoformat()[:10]
    return F.to_date(F.lit(v))


def filter_view(df: DataFrame, start, end, carriers: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Inclusive date range, optional carrier list (empty = all)."""
    s, e = _date(start), _date(end)
    cond = F.col("ship_date").between(s, e)
    if "ship_month" in df.columns:
        cond = cond & F.col("ship_month").between(F.trunc(s, "month"), F.trunc(e, "month"))
    if carriers:
        cond = cond & F.col("carrier").isin(list(carriers))
    return df.filter(cond)


def bounds(df: DataFrame, by=None) -> DataFrame:
    """One row with the first and last ship date of a view, or one row
    per slice of ``by``."""
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(F.min("ship_date").alias("first_date"), F.max("ship_date").alias("last_date"))


def window_dates(start, end) -> tuple[dt.date, dt.date]:
    """The two ends as dates (dates, timestamps or ISO texts)."""
    return tuple(dt.date.fromisoformat(v[:10]) if isinstance(v, str) else v.date() if isinstance(v, dt.datetime) else v
                 for v in (start, end))


def window_days(start, end) -> int:
    """Days of a window, both ends included."""
    first, last = window_dates(start, end)
    return (last - first).days + 1


def preset_window(df: DataFrame, preset: str = "13w") -> DataFrame:
    """One row (start, end) for a preset: all data, or the last N weeks
    before the latest ship date, clamped to the first."""
    weeks = PRESET_WEEKS[preset]
    b = bounds(df)
    if weeks is None:
        return b.select(F.col("first_date").alias("start"), F.col("last_date").alias("end"))
    return b.select(
        F.greatest(F.col("first_date"), F.date_sub(F.col("last_date"), 7 * weeks)).alias("start"),
        F.col("last_date").alias("end"),
    )


def resolve_window(window) -> tuple:
    """The (start, end) dates of a one-row window frame (or a pair as is).
    Bringing these two dates to the driver is what lets the view filters be
    literals: they reach the Parquet scan as pushed filters and prune
    ``ship_month`` partitions, where a join against the one-row frame would
    read the whole table and filter afterwards."""
    if isinstance(window, DataFrame):
        r = window.select("start", "end").first()
        return (r["start"], r["end"]) if r is not None else (None, None)
    return tuple(window)


def preset_view(df: DataFrame, preset: str = "13w", carriers=()) -> DataFrame:
    """Rows of a preset window: the bounds are resolved first (one small
    aggregate over ``ship_date``), then applied as literal range filters."""
    start, end = resolve_window(preset_window(df, preset))
    if start is None:
        return df.filter(F.lit(False))
    return filter_view(df, start, end, carriers)


def with_prior(df: DataFrame, window, carriers=()) -> DataFrame:
    """Rows of the window labelled ``current`` and of the equal-length
    window before it labelled ``prior``, from one scan. ``window`` is a
    one-row (start, end) frame or a (start, end) pair. The two windows are
    adjacent, so the scan reads one literal date range."""
    start, end = resolve_window(window)
    if start is None:
        return df.filter(F.lit(False)).withColumns(
            {"window": F.lit(None).cast("string"), "prior_days": F.lit(None).cast("int")})
    days = (end - start).days + 1
    prior_start = start - dt.timedelta(days=days)
    label = F.when(F.col("ship_date") >= _date(start), F.lit("current")).otherwise(F.lit("prior"))
    return filter_view(df, prior_start, end, carriers).withColumns(
        {"window": label, "prior_days": F.lit(days)})
