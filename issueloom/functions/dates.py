"""Times and Korea calendar days. Stored timestamps are UTC instants."""

from pyspark.sql import Column, functions as F

KOREA = "Asia/Seoul"


def korea_time(ts: Column) -> Column:
    """Wall clock in Korea, whatever the session time zone is."""
    return F.convert_timezone(None, F.lit(KOREA), ts.cast("timestamp_ntz"))


def korea_date(ts: Column) -> Column:
    return korea_time(ts).cast("date")


def korea_yesterday(as_of: Column) -> Column:
    return F.date_sub(korea_date(as_of), 1)


def week_end(day: Column) -> Column:
    """The Sunday that closed the last full week before `day`."""
    return F.date_sub(day, F.when(F.dayofweek(day) == 1, 7).otherwise(F.dayofweek(day) - 1))


def last_week_end(as_of: Column) -> Column:
    return week_end(korea_date(as_of))


def day_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def weekly_key(start: Column, end: Column) -> Column:
    return F.concat(F.lit("weekly:"), day_key(start), F.lit(":"), day_key(end))


def parse_weekly_key(key: Column) -> Column:
    """struct(start, end), or null when the key is not a weekly one."""
    shape = r"^weekly:(\d{4}-\d{2}-\d{2}):(\d{4}-\d{2}-\d{2})$"
    return F.when(
        key.rlike(shape),
        F.struct(F.regexp_extract(key, shape, 1).try_cast("date").alias("start"),
                 F.regexp_extract(key, shape, 2).try_cast("date").alias("end")),
    )


def minutes_since(ts: Column, as_of: Column) -> Column:
    """Whole minutes, half-even, at least one."""
    seconds = (F.unix_micros(as_of) - F.unix_micros(ts)) / 1e6
    return F.greatest(F.lit(1), F.rint(seconds / 60).cast("int"))


def published_at(raw: Column, as_of: Column) -> Column:
    """RFC 822 or ISO text to an instant; the ingest time when neither fits."""
    text = F.regexp_replace(F.trim(raw), "^[A-Za-z]{3,9},\\s*", "")
    zoned = F.regexp_replace(text, "(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(text),
        as_of,
    )
