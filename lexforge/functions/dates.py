"""Dates in mixed formats and gaps in months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d-MMM-yy", "dd-MMM-yyyy", "d MMMM yyyy", "MM/dd/yyyy"]
DAYS_A_MONTH = 30.4375


def parse_date(text: Column) -> Column:
    """The first format that fits, ISO dates by their first ten characters; null otherwise."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))
    return F.coalesce(iso.cast("date"), *[_in_format(t, f) for f in FORMATS[1:]])


def _in_format(text: Column, form: str) -> Column:
    """A date in a format; years of two digits are from 1969 to 2068."""
    d = F.try_to_timestamp(text, F.lit(form)).cast("date")
    return F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d) if form.endswith("-yy") else d


def months_between(later: Column, earlier: Column) -> Column:
    """Days over 30.4375: not calendar months."""
    return F.datediff(later, earlier) / F.lit(DAYS_A_MONTH)


def years_named(text: Column) -> Column:
    """Years from 1900 to 2099 that a text names, as 1 July of each."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda y: F.make_date(y.cast("int"), F.lit(7), F.lit(1)))


def median_low(dates: Column) -> Column:
    """Aggregate: the lower median of dates; percentile_disc takes numbers only."""
    days = F.array_sort(F.collect_list(F.unix_date(dates)))
    return F.date_from_unix_date(F.get(days, F.floor((F.size(days) - 1) / 2).cast("int")))
