"""Rules over times as Column expressions. Clocks are arguments, never the machine's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(last: Column, as_of: Column, days: int = 35) -> Column:
    """Seen within `days` before as_of; later times count too, null doesn't."""
    return F.coalesce(last >= as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def within_days(at: Column, now: Column, days: int = 7) -> Column:
    """In the last `days`; later times don't count."""
    return F.coalesce((at <= now) & (at >= now - F.make_dt_interval(F.lit(days))), F.lit(False))


def activity_time(published: Column, observed: Column) -> Column:
    return F.coalesce(published, observed)


def month_bounds(period: Column) -> tuple[Column, Column]:
    """[start, end) of a yyyy-MM month."""
    start = F.to_date(F.concat(period, F.lit("-01")))
    return start, F.add_months(start, 1)


def quarter_bounds(period: Column) -> tuple[Column, Column]:
    """[start, end) of a yyyy-Qn quarter; null for another form."""
    good = period.rlike(r"^\d{4}-Q[1-4]$")
    start = F.when(good, F.make_date(F.substring(period, 1, 4).cast("int"), F.substring(period, 7, 1).cast("int") * 3 - 2, F.lit(1)))
    return start, F.add_months(start, 3)


def year_bounds(year: Column) -> tuple[Column, Column]:
    """[start, end) of a year."""
    y = year.cast("int")
    return F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y + 1, F.lit(1), F.lit(1))


def exclusive_after(at: Column) -> Column:
    """The first instant after a time of millisecond precision."""
    return at + F.expr("INTERVAL 0.001 SECOND")


def earlier(a: Column, b: Column) -> Column:
    return F.when(a <= b, a).otherwise(b)


def of_year(year: Column) -> Column:
    """The start of a year of the 20th or 21st century written out; null otherwise."""
    y = F.trim(year)
    return F.when(y.rlike(r"^(?:19|20)\d{2}$"), F.to_date(F.concat(y, F.lit("-01-01"))))


def of_month(name: Column, year: Column) -> Column:
    """The start of a month by its English name; null for another name or year."""
    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    k = F.array_position(F.array(*map(F.lit, months)), F.lower(F.trim(name)))
    return F.when((k > 0) & of_year(year).isNotNull(), F.add_months(of_year(year), (k - 1).cast("int")))


def retry_at(header: Column, now: Column) -> Column:
    """When to try again by a Retry-After header: seconds from now, or a time in ISO form or as in mails; null otherwise."""
    h = F.trim(header)
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(h, r"(?i)^[a-z]{3},\s*", ""), r"(?i)\bGMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.when(h.rlike(r"^\d+$"), F.timestamp_seconds(F.unix_timestamp(now) + F.try_to_number(h, F.lit("999999999")).cast("long"))).when(h != "", F.coalesce(F.try_to_timestamp(h), mail))


def capture_is_fresh(captured: Column, now: Column, days: int = 1) -> Column:
    return F.coalesce(now - captured < F.make_dt_interval(F.lit(days)), F.lit(False))


def boundary_passed(end: Column, as_of: Column) -> Column:
    return as_of >= end


def previous_keys(as_of: Column) -> tuple[Column, Column, Column]:
    """The last whole month before a time, and that month's quarter and year."""
    m = F.add_months(F.trunc(as_of, "MM"), -1)
    return F.date_format(m, "yyyy-MM"), F.concat(F.date_format(m, "yyyy"), F.lit("-Q"), F.quarter(m).cast("string")), F.date_format(m, "yyyy")
