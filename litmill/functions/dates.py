"""Dates as bibliographic sources write them, and the recency score."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from litmill.functions import text

# Month names, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def iso_date(c: Column) -> Column:
    """Date from the first ten characters if they are a full ISO date, else null."""
    head = F.substring(c, 1, 10)
    return F.when(
        head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")
    )


def month_number(c: Column) -> Column:
    """1..12 from digits or an English month name, else null."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    number = F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    return F.coalesce(
        F.when(number.between(1, 12), number),
        F.try_element_at(names, F.lower(F.substring(c, 1, 3))),
    )


def year_number(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy, yyyy-MM or yyyy-MM-dd, as far as the parts go (month names allowed)."""
    y, m = year_number(year), month_number(month)
    d = F.when(day.rlike("^[0-9]+$"), day.try_cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    four = F.lpad(y.cast("string"), 4, "0")
    return (
        F.when(m.isNotNull() & d.isNotNull(), F.concat_ws("-", four, two(m), two(d)))
        .when(m.isNotNull(), F.concat_ws("-", four, two(m)))
        .otherwise(y.cast("string"))
    )


def padded_date(year: Column, month: Column, day: Column) -> Column:
    """Parts joined by dashes, numeric months and days padded to two digits."""
    pad = lambda c: F.when(c.rlike("^[0-9]$"), F.lpad(c, 2, "0")).otherwise(c)
    y, m, d = (text.single_line(c) for c in (year, month, day))
    return F.when(y.isNotNull(), F.concat_ws("-", y, pad(m), pad(d)))


def recency(date: Column, year: Column, reference: dt.date) -> Column:
    """20 + 80*exp(-age/7) with age in years, July 1st for a bare year, 50 if unknown."""
    day = F.coalesce(date, F.when(year.isNotNull(), F.make_date(year, F.lit(7), F.lit(1))))
    age = F.greatest(F.lit(0.0), F.datediff(F.lit(reference), day) / F.lit(365.25))
    return F.coalesce(F.lit(20.0) + F.lit(80.0) * F.exp(-age / F.lit(7.0)), F.lit(50.0))
