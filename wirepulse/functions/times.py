"""Time functions on columns. None reads a clock: "now" is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from wirepulse.functions.text import let, to_fixed

ZONE = "America/New_York"


def instant(value) -> Column:
    """A timestamp column from a datetime, a string or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.to_timestamp(F.lit(value))


def shift(ts: Column, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds), ts)


def ms_between(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


# Zone names RFC-822 dates may end with. They mean a fixed offset;
# Java would read "EST" in summer as daylight saving time.
ZONE_OFFSETS = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def parse_feed_date(text: Column) -> Column:
    """RFC-822 or ISO-8601 text to a timestamp, null when it is neither.

    Also read: two-digit years (50 to 99 are of the last century), month names in
    full, one-digit hours, offsets with a colon, a closing comment, and
    "Oct 2, 2002".
    """
    offsets = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])
    forms = ("d MMM yyyy H:mm:ss Z", "d MMM yyyy H:mm Z", "d MMM yyyy H:mm:ss", "d MMM yyyy H:mm", "d MMM yyyy")
    rewrites = (
        (r" ?\([^)]*\)$", ""),
        (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?(?= )", "$1"),
        (r"^([A-Za-z]{3}) (\d{1,2}),? (?=\d{4})", "$2 $1 "),
        (r"^(\d{1,2} [A-Za-z]{3}) ([0-4]\d)(?=\D|$)", "$1 20$2"),
        (r"^(\d{1,2} [A-Za-z]{3}) ([5-9]\d)(?=\D|$)", "$1 19$2"),
        (r"([+-]\d{2}):(\d{2})$", "$1$2"),
    )

    def usual(bare: Column) -> Column:
        for pattern, instead in rewrites:
            bare = F.regexp_replace(bare, pattern, instead)
        return bare

    def with_offset(bare: Column) -> Column:
        offset = F.element_at(offsets, F.upper(F.regexp_extract(bare, "([A-Za-z]+)$", 1)))
        return F.when(offset.isNotNull(), F.concat(F.regexp_replace(bare, "[A-Za-z]+$", ""), offset)).otherwise(bare)

    def read(bare: Column) -> Column:
        rfc = let(with_offset(usual(bare)), lambda t: F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms]))
        return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), bare.try_cast("timestamp")).otherwise(rfc)

    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "^[A-Za-z]{3,9}, *", "")
    return let(bare, read)


def no_future(ts: Column, now, seconds: int = 3600) -> Column:
    """Null for times further ahead of ``now`` than clock skew explains."""
    return F.when(ts <= shift(instant(now), seconds), ts)


def format_duration(ms: Column) -> Column:
    """0s / 45s / 2m 14s / 1h 0m."""
    seconds = F.floor(ms / 1000 + 0.5).cast("bigint")
    minutes = F.floor(seconds / 60)
    return (
        F.when(ms < 0, "0s")
        .when(minutes == 0, F.concat(seconds.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def ago(ts: Column, now: Column) -> Column:
    return F.when(ts.isNull(), "never").otherwise(F.concat(format_duration(ms_between(ts, now)), F.lit(" ago")))


def age_text(ms: Column) -> Column:
    """59m / 3.5h / 2.0d, "unknown" when null."""
    minutes = F.floor(ms / 60000 + 0.5)
    return (
        F.when(ms.isNull(), "unknown")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(minutes < 1440, F.concat(to_fixed(minutes / F.lit(60.0), 1), F.lit("h")))
        .otherwise(F.concat(to_fixed(minutes / F.lit(1440.0), 1), F.lit("d")))
    )


def format_et_time(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "HH:mm")


def format_et_datetime(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "MMM d, HH:mm")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
