"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_prefix_date(c: Column) -> Column:
    """DATE from the year-month-day a text begins with; what follows is ignored. Null if the text does not begin so or the
    day does not exist. A two-digit start is a year of the first century, as with the C parser."""
    s = F.regexp_extract(c, r"^\s*(\d{1,4}-\d{1,2}-\d{1,2})", 1)
    return F.try_to_date(F.nullif(s, F.lit("")), "y-M-d")


def is_leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def leap_issue(c: Column) -> Column:
    """Whether a text is a 29th of February of a year without one. Slashes count as dashes, a time after T is cut off. Anything else, null
    too, is false."""
    p = F.split(F.regexp_extract(F.replace(c, F.lit("/"), F.lit("-")), r"^([^T]*)", 1), "-", -1)
    y, m, d = (F.get(p, F.lit(i)).try_cast("int") for i in range(3))
    hit = (F.size(p) == 3) & (m == 2) & (d == 29) & ~is_leap_year(y)
    return F.coalesce(hit, F.lit(False))


def format_date_ord(c: Column, null_text: str = "NAth NA NA") -> Column:
    """2nd Jan 2020; null gives null_text."""
    d = F.dayofmonth(c)
    suffix = (
        F.when((d % 100).between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    )
    return F.when(c.isNull(), F.lit(null_text)).otherwise(F.concat(d.cast("string"), suffix, F.lit(" "), F.date_format(c, "MMM yyyy")))


def half_year_label(c: Column) -> Column:
    """Jan yy / Jun yy or Jul yy / Dec yy, the year without leading zero; null gives Other."""
    y = (F.year(c) % 100).cast("string")
    first, last = F.when(F.month(c) <= 6, "Jan").otherwise("Jul"), F.when(F.month(c) <= 6, "Jun").otherwise("Dec")
    return F.when(c.isNull(), "Other").otherwise(F.concat(first, F.lit(" "), y, F.lit(" / "), last, F.lit(" "), y))


def half_year_start(c: Column) -> Column:
    """First day of the half-year, the order of the labels."""
    return F.make_date(F.year(c), F.when(F.month(c) <= 6, 1).otherwise(7), F.lit(1))


def epi_week(c: Column) -> Column:
    """Week of the year with weeks from Sunday to Saturday; week 1 has at least four days of the year."""
    middle = F.date_add(c, 4 - F.dayofweek(c))  # Wednesday of the week
    return (F.floor((F.dayofyear(middle) - 1) / 7) + 1).cast("int")


def iso_year(c: Column) -> Column:
    """Year of the ISO week: that of its Thursday."""
    return F.year(F.date_add(c, 3 - F.weekday(c)))
