"""Instants (epoch milliseconds) and durations as short texts."""

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from fleetlens import fixed

MINUTE_MS, HOUR_MS, DAY_MS = 60_000, 3_600_000, 86_400_000
LAST_INSTANT_MS = 8_640_000_000_000_000  # the furthest a browser date goes, either way


def to_millis(at: datetime | int) -> int:
    """A driver-side instant as epoch milliseconds; naive times count as UTC."""
    if isinstance(at, int):
        return at
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    return int(at.timestamp() * 1000)


def epoch_millis(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp, whatever the session time zone is."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", start, ts.cast("timestamp_ntz"))


def utc_text(ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session time zone is."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.floor(ms / 1000), start).cast("string")


def age_text(ms: Column, as_of: datetime | int) -> Column:
    """How long before ``as_of``; a future instant reads as just now."""
    age = F.lit(to_millis(as_of)) - ms

    def ago(unit_ms: int, word: str) -> Column:
        return F.concat(F.floor(age / unit_ms).cast("string"), F.lit(word))

    return (
        F.when(age < MINUTE_MS, fixed.JUST_NOW)
        .when(age < HOUR_MS, ago(MINUTE_MS, fixed.MINUTES_AGO))
        .when(age < DAY_MS, ago(HOUR_MS, fixed.HOURS_AGO))
        .otherwise(ago(DAY_MS, fixed.DAYS_AGO))
    )


def _missing(x: Column) -> Column:
    return x.isNull() | (x == 0)


def format_timestamp(ms: Column, as_of: datetime | int, humanize: bool = True) -> Column:
    """Date, time and age; a zero or missing instant is not available.

    A number too large for a date is shown as such, so that one bad record cannot fail a job.
    """
    if not humanize:
        return F.when(_missing(ms), fixed.NOT_AVAILABLE).otherwise(ms.cast("string"))
    text = F.concat(utc_text(ms), F.lit(" ("), age_text(ms, as_of), F.lit(")"))
    return (
        F.when(_missing(ms), fixed.NOT_AVAILABLE)
        .when(ms.between(-LAST_INSTANT_MS, LAST_INSTANT_MS), text)
        .otherwise("Invalid Date")
    )


def format_elapsed(ms: Column, humanize: bool = True) -> Column:
    """Days, hours, minutes and seconds without the zero parts."""
    if not humanize:
        return F.when(_missing(ms), fixed.NOT_AVAILABLE).otherwise(ms.cast("string"))
    total = F.floor(ms / 1000)
    amounts = [
        (F.floor(total / 86400), fixed.DAY),
        (F.floor((total % 86400) / 3600), fixed.HOUR),
        (F.floor((total % 3600) / 60), fixed.MINUTE),
        (total % 60, fixed.SECOND),
    ]
    parts = [F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))) for n, unit in amounts]
    text = F.concat_ws("", *parts)
    return (
        F.when(_missing(ms), fixed.NOT_AVAILABLE)
        .when(text == "", F.lit("0" + fixed.SECOND))
        .otherwise(text)
    )


def format_duration(sec: Column) -> Column:
    """The two largest parts of a duration in seconds."""

    def whole(x: Column) -> Column:
        return F.floor(x).cast("string")

    minutes = F.concat(whole(sec / 60), F.lit("m "), (sec % 60).cast("string"), F.lit("s"))
    hours = F.concat(whole(sec / 3600), F.lit("h "), whole((sec % 3600) / 60), F.lit("m"))
    return (
        F.when(sec.isNull() | (sec <= 0), fixed.DASH)
        .when(sec < 60, F.concat(sec.cast("string"), F.lit("s")))
        .when(sec < 3600, minutes)
        .otherwise(hours)
    )
