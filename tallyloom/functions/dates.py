"""Dates: strict parsing per format, months as yyyy-MM, calendar arithmetic. The current day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.money import trimmed

#: The formats of statement files, in the order in which they are tried, and what makes an ISO day of each.
FORMATS = {
    "DD/MM/YYYY": (r"^([0-9]{2})/([0-9]{2})/((?!0000)[0-9]{4})\z", "$3-$2-$1"),
    "YYYY-MM-DD": (r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z", None),
    "DD.MM.YY": (r"^([0-9]{2})\.([0-9]{2})\.([0-9]{2})\z", "20$3-$2-$1"),
}


def parse_date(text: Column, form: str) -> Column:
    """Null unless the text has the format and names a day of the calendar; two-digit years are 20YY."""
    shape, iso = FORMATS[form]
    bare = trimmed(text)
    day = bare if iso is None else F.regexp_replace(bare, shape, iso)
    return F.when(bare.rlike(shape), day.try_cast("date"))


def parse_date_as(text: Column, form: Column) -> Column:
    """The same with a format that differs by row."""
    out = F.lit(None).cast("date")
    for name in FORMATS:
        out = F.when(form == name, parse_date(text, name)).otherwise(out)
    return out


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_start(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def shifted_month(month: Column, by: int) -> Column:
    return month_of(F.add_months(month_start(month), by))


def day_distance(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(a, b))


def local_day(instant: Column, zone: str = "Europe/Brussels") -> Column:
    """The day of an instant (UTC) in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def asked_month(asked: Column, current: Column) -> Column:
    """The month asked for, or the current one if none, no month, or a later one is asked for."""
    good = asked.rlike("^[0-9]{4}-(?:0[1-9]|1[0-2])$")
    return F.when(good & (asked <= current), asked).otherwise(current)
