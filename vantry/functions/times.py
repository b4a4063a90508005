"""Timestamp parsing and time expressions (naive timestamps, UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import DATE_MISSING_TOKENS

_TIME = r"\d{1,2}:\d{2}(:\d{2})?"

# --- fixed values: text shapes and the formats tried for each -----------------
# A cheap shape test picks the format, so a value is parsed once and no format
# is tried in vain. {A}/{B} are day and month in the order the caller asks for.
SHAPES = [
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}} {_TIME}$", "yyyy-M-d H:mm[:ss]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}Z?$", "yyyy-M-d'T'H:mm:ss['Z']"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}:\d{2}\.\d{1,6}Z?$", "yyyy-M-d['T'][' ']H:mm:ss.SSSSSS['Z']"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}Z?$", "yyyy-M-d'T'H:mm['Z']"),
    (rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}} {_TIME}$", "yyyy/M/d H:mm[:ss]"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}} {_TIME}$", "{A}-{B}-yyyy H:mm[:ss]"),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_TIME}$", "{A}/{B}/yyyy H:mm[:ss]"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "{A}-{B}-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "{A}/{B}/yyyy"),
    (rf"(?i)^\d{{1,2}}-\d{{1,2}}-\d{{4}} {_TIME} [ap]m$", "M-d-yyyy h:mm[:ss] a"),
    (rf"(?i)^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_TIME} [ap]m$", "M/d/yyyy h:mm[:ss] a"),
    (rf"(?i)^\d{{1,2}}-[a-z]{{3}}-\d{{4}} {_TIME}$", "d-MMM-yyyy H:mm[:ss]"),
    (rf"(?i)^\d{{1,2}}-[a-z]{{3}}-\d{{4}} {_TIME} [ap]m$", "d-MMM-yyyy h:mm[:ss] a"),
    (r"(?i)^\d{1,2}-[a-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"(?i)^\d{1,2}-[a-z]{4,}-\d{4}$", "d-MMMM-yyyy"),
    (r"(?i)^[a-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"(?i)^[a-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"(?i)^[a-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"(?i)^[a-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (rf"(?i)^[a-z]{{3}} \d{{1,2}},? \d{{4}} {_TIME}$", "MMM d[,] yyyy H:mm[:ss]"),
    (rf"(?i)^[a-z]{{4,}} \d{{1,2}},? \d{{4}} {_TIME}$", "MMMM d[,] yyyy H:mm[:ss]"),
    (r"(?i)^\d{1,2} [a-z]{3} \d{4}$", "d MMM yyyy"),
    (r"(?i)^\d{1,2} [a-z]{4,} \d{4}$", "d MMMM yyyy"),
    (rf"(?i)^\d{{1,2}} [a-z]{{3}} \d{{4}} {_TIME}$", "d MMM yyyy H:mm[:ss]"),
    (rf"(?i)^\d{{1,2}} [a-z]{{4,}} \d{{4}} {_TIME}$", "d MMMM yyyy H:mm[:ss]"),
]
ZONED = r"^(\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?) ?([+-]\d{2}):?(\d{2})$"

# the commonest shapes, read by a cast; the year zero, which a cast would take, goes the long way
PLAIN = r"^(?!0000)\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2}|T\d{2}:\d{2}:\d{2}Z?)\z"
SLASHED = r"^(?!0000)\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\z"
YEAR_LAST = r"^\d{2}([/-])\d{2}\1(?!0000)\d{4} \d{2}:\d{2}:\d{2}\z"


def _try(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def _offset_minutes(t: Column) -> Column:
    """Minutes that the zone offset of a text lies east of UTC, 0 without one."""
    part = lambda i: F.regexp_extract(t, ZONED, i).try_cast("int")
    sign = F.when(F.regexp_extract(t, ZONED, 2).startswith("-"), -1).otherwise(1)
    return F.coalesce(part(2) * 60 + sign * part(3), F.lit(0))


def parse_timestamp(t: Column, day_first: bool = True, epoch: bool = True, to_utc: bool = False) -> Column:
    """Naive timestamp from mixed text (already trimmed), NULL when nothing fits.

    ``day_first`` settles ambiguous ``1/2/2024``; the other order is tried when
    the first gives no date. ``epoch`` reads ten digits as seconds. A zone offset is
    dropped, or with ``to_utc`` subtracted. Fractions count to microseconds.
    """
    zoned = F.contains(t, F.lit(":"))
    bare = F.regexp_replace(F.regexp_replace(t, ZONED, "$1"), r"(\.\d{6})\d+", "$1")
    orders = (("d", "M"), ("M", "d")) if day_first else (("M", "d"), ("d", "M"))

    def parse(x: Column) -> Column:
        out = None
        if epoch:
            seconds = F.timestamp_seconds(x.try_cast("bigint")).cast("timestamp_ntz")
            out = F.when(x.rlike(r"^\d{10}$"), seconds)
        for shape, pattern in SHAPES:
            if "{A}" in pattern:
                value = F.coalesce(*[_try(x, pattern.format(A=a, B=b)) for a, b in orders])
            else:
                value = _try(x, pattern)
            out = F.when(x.rlike(shape), value) if out is None else out.when(x.rlike(shape), value)
        return out

    # bound to a name, so that the cleaned text is made once and not once a shape
    out = F.transform(F.array(F.when(zoned, bare).otherwise(t)), parse)[0]
    if to_utc:
        out = F.when(zoned & t.rlike(ZONED), out - F.make_dt_interval(mins=_offset_minutes(t))).otherwise(out)
    part = lambda at, n: F.substring(t, at, n)
    turned = [F.concat_ws("-", part(7, 4), part(m, 2), F.concat(part(d, 2), part(11, 9))) for m, d in ((4, 1), (1, 4))]
    cast = lambda x: x.try_cast("timestamp_ntz")
    quick = F.when(t.rlike(PLAIN), cast(t)).when(t.rlike(SLASHED), cast(F.translate(t, "/", "-")))
    quick = quick.when(t.rlike(YEAR_LAST), F.coalesce(*[cast(x) for x in (turned if day_first else turned[::-1])]))
    if epoch:
        quick = quick.when(t.rlike(r"^\d{10}\z"), F.timestamp_seconds(t.try_cast("bigint")).cast("timestamp_ntz"))
    return quick.otherwise(out)


def parse_identity_date(t: Column) -> Column:
    """Dates of the identity master: missing words, spreadsheet serials, text."""
    serial = t.try_cast("int")
    from_serial = F.date_add(F.lit("1899-12-30").cast("date"), serial).cast("timestamp_ntz")
    return (
        F.when(F.lower(t).isin(DATE_MISSING_TOKENS), None)
        .when(t.rlike(r"^\d{5}$") & serial.between(20000, 60000), from_serial)
        .otherwise(parse_timestamp(t, day_first=True))
    )


def as_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def off_hours(ts: Column) -> Column:
    """Hour 18 or later, or before 6."""
    return (F.hour(ts) >= 18) | (F.hour(ts) < 6)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a naive timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def ends_before_start(start: Column, end: Column) -> Column:
    return F.coalesce(end < start, F.lit(False))


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, NULL when one is missing or the order is wrong."""
    return F.when(end >= start, (micros(end) - micros(start)) / F.lit(3.6e9))
