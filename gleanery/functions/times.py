"""Time functions over columns. `now` is always an argument; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since 1970 with fraction."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def age_hours(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9


def freshness(ts: Column, now: Column) -> Column:
    """100 up to six hours of age, then 80, 60 and 35 up to 12, 24 and 36, else 0; what lies ahead is fresh, no time is 0."""
    age = age_hours(ts, now)
    return F.when(age.isNull(), 0.0).when(age <= 6, 100.0).when(age <= 12, 80.0).when(age <= 24, 60.0).when(age <= 36, 35.0).otherwise(0.0)


def editorial_freshness(ts: Column, now: Column) -> Column:
    age = F.greatest(age_hours(ts, now), F.lit(0.0))
    return F.when(ts.isNull(), 0.0).when(age <= 6, 2.0).when(age <= 24, 1.8).when(age <= 36, 1.5).when(age <= 72, 0.8).otherwise(0.2)


def fresh_snapshot(ts: Column, now: Column, most_hours: float = 6.0, ahead_minutes: float = 5.0) -> Column:
    """At most so old and at most so far ahead, both bounds included."""
    age = age_hours(ts, now)
    return F.coalesce((age >= -ahead_minutes / 60) & (age <= most_hours), F.lit(False))


def report_date(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd")


def month_day(day: Column) -> Column:
    return F.concat(F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))


def palette(day: Column, size: int = 8) -> Column:
    return F.pmod(F.datediff(day, F.lit("2026-01-01").cast("date")), F.lit(size))


def aware(value: Column) -> Column:
    """An ISO time that names its offset, else null."""
    return F.when(value.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(value))


def url_date(url: Column) -> Column:
    """A date in a path (/2026/07/08/) or else in a query (date=2026-07-08), or null."""
    in_path = F.regexp_extract(url, r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/", 0)
    made = F.regexp_replace(F.trim(F.translate(in_path, "/", " ")), " ", "-")
    in_query = F.regexp_extract(url, r"[?&]date=([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.try_to_timestamp(F.when(in_path != "", made).when(in_query != "", in_query), F.lit("yyyy-MM-dd"))


def post_time(value: Column) -> Column:
    """An ISO time, or one of the form `Wed Jul 08 12:00:00 +0000 2026`, else null."""
    shape = r"^[A-Za-z]{3} ([A-Za-z]{3}) ([0-9]{1,2}) ([0-9:]{8}) ([+-][0-9]{4}) ([0-9]{4})$"
    parts = F.concat_ws(" ", F.lpad(F.regexp_extract(value, shape, 2), 2, "0"), F.regexp_extract(value, shape, 1), F.regexp_extract(value, shape, 5), F.regexp_extract(value, shape, 3), F.regexp_extract(value, shape, 4))
    return F.coalesce(aware(value), F.when(value.rlike(shape), F.try_to_timestamp(parts, F.lit("dd MMM yyyy HH:mm:ss Z"))))


def published(parsed: list[tuple[str, Column]], url: Column) -> Column:
    """struct<ts, label>: the first of the labelled times that is not null, else the date in the url, else none."""
    options = [*parsed, ("url_date", url_date(url))]
    label = F.lit("missing")
    for name, ts in reversed(options):
        label = F.when(ts.isNotNull(), name).otherwise(label)
    return F.struct(F.coalesce(*[ts for _, ts in options]).alias("ts"), label.alias("label"))
