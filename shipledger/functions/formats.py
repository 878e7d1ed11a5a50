"""Display formatting as column expressions (X1-X7), so report tables are
formatted inside the job instead of row by row on the driver.

Rules: grouping with a narrow no-break space, a true minus sign, ISO currency
code before the value, at most three significant figures in the compact form,
rounding half away from zero at display time. ``format_number`` rounds half
to even, so every value is rounded with ``round`` (half up) first.

Each formatter exists twice: ``*_sql(expr)`` returns Spark SQL text for an
SQL expression, and ``fmt_*(c)`` returns a Column for a column name / SQL
text (one ``expr`` call) or a Column. Composite report texts are assembled as
one SQL expression, which keeps plan construction cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# typography
NNBSP = "\u202f"  # narrow no-break space
MINUS = "\u2212"  # true minus sign
NONE = "none"


def sq(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _d(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def _fixed(v: str, d: int) -> str:
    return f"format_string('%.{d}f', {v})"


def _wrap_null(x: str, body: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN {sq(NONE)} ELSE {body} END"


def group_sql(x: str, d: int = 0) -> str:
    r = f"round(abs({_d(x)}), {d})"
    sign = f"CASE WHEN {_d(x)} < 0 AND {r} <> 0 THEN {sq(MINUS)} ELSE '' END"
    return _wrap_null(x, f"concat({sign}, translate(format_number({r}, {d}), ',', {sq(NNBSP)}))")


def compact_sql(x: str) -> str:
    a = f"abs({_d(x)})"
    body = (
        f"CASE WHEN {a} >= 1e9 THEN concat({_fixed(f'round({a} / 1e9, 1)', 1)}, 'bn') "
        f"WHEN {a} >= 1e7 THEN concat({_fixed(f'round({a} / 1e6, 1)', 1)}, 'M') "
        f"WHEN {a} >= 1e6 THEN concat({_fixed(f'round({a} / 1e6, 2)', 2)}, 'M') "
        f"WHEN {a} >= 1e4 THEN concat({_fixed(f'round({a} / 1e3, 0)', 0)}, 'k') "
        f"WHEN {a} >= 1e3 THEN concat({_fixed(f'round({a} / 1e3, 1)', 1)}, 'k') "
        f"ELSE {_fixed(f'round({a}, 0)', 0)} END"
    )
    sign = f"CASE WHEN {_d(x)} < 0 THEN {sq(MINUS)} ELSE '' END"
    return _wrap_null(x, f"concat({sign}, {body})")


def money_sql(x: str, currency: str = "EUR", exact: bool = False) -> str:
    body = group_sql(x, 0) if exact else compact_sql(x)
    return _wrap_null(x, f"concat({sq(currency + NNBSP)}, {body})")


def pct_sql(x: str, decimals: int | None = None, signed: bool = False) -> str:
    a = f"abs({_d(x)})"

    def render(d: int) -> str:
        r = f"round({a}, {d})"
        plus = f"WHEN {r} > 0 THEN '+' " if signed else ""
        sign = f"CASE WHEN {_d(x)} < 0 AND {r} <> 0 THEN {sq(MINUS)} {plus}ELSE '' END"
        return f"concat({sign}, {_fixed(r, d)}, '%')"

    body = f"CASE WHEN {a} > 0 AND {a} < 1 THEN {render(2)} ELSE {render(1)} END" if decimals is None else render(decimals)
    return _wrap_null(x, body)


def pts_sql(x: str, decimals: int = 1) -> str:
    r = f"round(abs({_d(x)}), {decimals})"
    sign = f"CASE WHEN {_d(x)} < 0 AND {r} <> 0 THEN {sq(MINUS)} WHEN {r} > 0 THEN '+' ELSE '' END"
    return _wrap_null(x, f"concat({sign}, {_fixed(r, decimals)}, ' pts')")


def signed_change_sql(new: str, old: str) -> str:
    return (f"CASE WHEN ({new}) IS NOT NULL AND ({old}) IS NOT NULL AND {_d(old)} <> 0 "
            f"THEN {pct_sql(f'100.0 * ({_d(new)} / {_d(old)} - 1.0)', 1, True)} END")


def days_sql(x: str, decimals: int = 1) -> str:
    return _wrap_null(x, f"concat({_fixed(f'round({_d(x)}, {decimals})', decimals)}, ' days')")


def ratio_sql(x: str, decimals: int = 2) -> str:
    return _wrap_null(x, _fixed(f"round({_d(x)}, {decimals})", decimals))


def iso_sql(x: str) -> str:
    return _wrap_null(x, f"date_format({x}, 'yyyy-MM-dd')")


def month_sql(x: str) -> str:
    return _wrap_null(x, f"date_format({x}, 'MMMM yyyy')")


def prose_date_sql(x: str) -> str:
    return _wrap_null(x, f"date_format({x}, 'd MMMM yyyy')")


def prose_range_sql(a: str, b: str) -> str:
    return (f"CASE WHEN year({a}) = year({b}) AND month({a}) = month({b}) "
            f"THEN concat(CAST(dayofmonth({a}) AS STRING), ' to ', date_format({b}, 'd MMMM yyyy')) "
            f"WHEN year({a}) = year({b}) THEN concat(date_format({a}, 'd MMMM'), ' to ', date_format({b}, 'd MMMM yyyy')) "
            f"ELSE concat({prose_date_sql(a)}, ' to ', {prose_date_sql(b)}) END")


def timestamp_sql(x: str, zone: str = "UTC") -> str:
    return _wrap_null(x, f"concat(date_format({x}, 'yyyy-MM-dd HH:mm'), {sq(' ' + zone)})")


def week_sql(x: str) -> str:
    return _wrap_null(x, f"concat('W', lpad(CAST(weekofyear({x}) AS STRING), 2, '0'), ' ', "
                         f"CAST(extract(YEAROFWEEK FROM {x}) AS STRING))")


# ---------------------------------------------------------------------------
# Column API (argument: a column name or SQL text)
# ---------------------------------------------------------------------------

def fmt_group(c, d: int = 0) -> Column:
    """1 204 812.5 with U+202F grouping; 'none' for null."""
    return _named(c, lambda x: group_sql(x, d))


def fmt_count(c) -> Column:
    return fmt_group(c, 0)


def fmt_compact(c) -> Column:
    """812, 1.5k, 184k, 1.24M, 12.4M, 1.2bn (band chosen before rounding)."""
    return _named(c, compact_sql)


def fmt_money(c, currency: str = "EUR", exact: bool = False) -> Column:
    """X3: 'EUR 184k', or 'EUR 184 212' when exact."""
    return _named(c, lambda x: money_sql(x, currency, exact))


def fmt_pct(c, decimals: int | None = None, signed: bool = False) -> Column:
    """X4: '12.4%', two decimals when 0 < |v| < 1, '+' only when signed."""
    return _named(c, lambda x: pct_sql(x, decimals, signed))


def fmt_pts(c, decimals: int = 1) -> Column:
    """A change in a rate, '+1.8 pts'."""
    return _named(c, lambda x: pts_sql(x, decimals))


def fmt_signed_change(new: str, old: str) -> Column:
    """Relative change as a signed percent; null when there is no basis."""
    return F.expr(signed_change_sql(new, old))


def fmt_days(c, decimals: int = 1) -> Column:
    return _named(c, lambda x: days_sql(x, decimals))


def fmt_ratio(c, decimals: int = 2) -> Column:
    return _named(c, lambda x: ratio_sql(x, decimals))


def fmt_iso(c) -> Column:
    """2026-09-11."""
    return _named(c, iso_sql)


def fmt_iso_range(a: str, b: str) -> Column:
    return F.expr(f"concat({iso_sql(a)}, ' to ', {iso_sql(b)})")


def fmt_month(c) -> Column:
    return _named(c, month_sql)


def fmt_prose_date(c) -> Column:
    return _named(c, prose_date_sql)


def fmt_prose_range(a: str, b: str) -> Column:
    return F.expr(prose_range_sql(a, b))


def fmt_timestamp(c, zone: str = "UTC") -> Column:
    return _named(c, lambda x: timestamp_sql(x, zone))


def fmt_week(c) -> Column:
    """ISO week with its ISO year, 'W36 2026'."""
    return _named(c, week_sql)


def fmt_week_range(a: str, b: str) -> Column:
    return F.expr(f"concat({week_sql(a)}, ' to ', {week_sql(b)})")


def _named(c: str, make) -> Column:
    """One ``expr`` call for a column name or SQL text."""
    if not isinstance(c, str):
        raise TypeError("formatters take a column name or SQL text")
    return F.expr(make(c))
