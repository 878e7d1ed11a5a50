"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shipledger.constants import MONTHS, WEEKDAYS
from shipledger.functions.text import col_, strip_ws

_TIME = r"(?:[T ]+(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?(?: ?[AaPp][Mm])?(?: ?(?:Z|UTC|[+-]\d{2}:?\d{2}))?)?"
#: three numbers with one separator
_NUMBERS = r"^\d{1,4}([-/.])\d{1,2}\1\d{1,4}" + _TIME + "$"
#: month and day with the year last, either way round
_NAMED = r"^(?:\p{L}+\.? \d{1,2},? \d{4}|\d{1,2}[- ]\p{L}+\.?[- ,]+(?:\d{2}|\d{4}))" + _TIME + "$"
#: between the parts of a date, and between its last part and a time
_BETWEEN = r"(?<=\d)T(?=\d)|[^\p{L}0-9]+"


def date_parts(c: str | Column) -> Column:
    """The first three parts of a date text, and the rest (an array). What lies
    between becomes one space first: ``split`` compiles any longer pattern anew
    for each row, ``regexp_replace`` once a task."""
    return F.split(F.regexp_replace(strip_ws(col_(c)), _BETWEEN, " "), " ", 4)


def parse_ship_date(c: str | Column, formats: list[str] | None = None, parts: Column | None = None) -> Column:
    """Mixed-layout, day-first date parse; anything unparseable is null, the
    time of day and the zone are dropped. Surrounding white space is ignored.

    A value has one of three shapes, told apart by one test each: three
    numbers (year first, or day first; month first only where the second
    number cannot be a month), a named month, or eight digits. Two-digit years
    are 1970 to 2069. ``parts`` may give ``date_parts`` of the column, so that
    it is split once. ``formats`` tries the given Spark patterns instead."""
    v = strip_ws(col_(c))
    if formats is not None:
        return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in formats]).cast("date")
    parts = date_parts(c) if parts is None else parts
    a, b, z = (F.get(parts, F.lit(k)) for k in range(3))
    number = lambda x: x.try_cast("int")

    def full_year(y: Column) -> Column:
        return F.when(F.length(y) == 4, number(y)).when(
            F.length(y) == 2, F.when(number(y) < 70, number(y) + 2000).otherwise(number(y) + 1900))

    def made(y: Column, m: Column, d: Column) -> Column:
        month_known = m.between(1, 12) & (y >= 1)
        # days that every month has need no test; the others are null where the month lacks them
        return F.when(month_known & d.between(1, 28), F.make_date(y, m, d)).when(
            month_known & d.between(29, 31) & (d <= F.day(F.last_day(F.make_date(y, m, F.lit(1))))), F.make_date(y, m, d))

    swapped = (number(b) > 12) & (number(a) <= 12)
    numbers = F.when(F.length(a) == 4, made(full_year(a), number(b), number(z))).when(
        F.length(a) <= 2, F.when(swapped, made(full_year(z), number(a), number(b))).otherwise(
            made(full_year(z), number(b), number(a))))
    months = {name: k + 1 for k, m in enumerate(MONTHS) for name in (m, m[:3])} | {"sept": 9}
    month_of = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    # a part of a named date is digits or letters throughout; a cast that fails costs more than this look
    named = F.when(~((b >= "0") & (b < ":")), made(full_year(z), F.element_at(month_of, F.lower(b)), number(a))).otherwise(
        made(full_year(z), F.element_at(month_of, F.lower(a)), number(b)))
    return (F.when(v.rlike(_NUMBERS), numbers)
            .when(v.rlike(_NAMED), named)
            .when(v.rlike(r"^\d{8}$"), F.try_to_timestamp(v, F.lit("yyyyMMdd")).cast("date")))


def weekday_name(c: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(col_(c)) + 1)


def week_start(c: str | Column) -> Column:
    """Monday of the week."""
    return F.trunc(col_(c), "week")


def month_start(c: str | Column) -> Column:
    return F.trunc(col_(c), "month")
