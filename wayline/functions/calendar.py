"""Clock, weekday and period notations, parsed on the driver, and the local calendar columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: The default day groups. The dash is U+2013.
DAY_GROUPS = {"Mon–Thu": (0, 1, 2, 3), "Fri": (4,), "Sat": (5,), "Sun": (6,)}
#: The default bins of a day-and-time summary.
TIME_BINS = ("6:30AM-9:00AM", "9:00AM-2:00PM", "2:00PM-7:00PM", "7:00PM-6:30AM")


def parse_clock(text: str) -> int:
    """Seconds after midnight of '6:30AM' or '9PM'; case and spaces don't matter."""
    found = re.fullmatch(r"(\d{1,2})(?::(\d{2}))?([AP])M", re.sub(r"\s+", "", text).upper())
    if not found or not 1 <= int(found[1]) <= 12 or int(found[2] or 0) > 59:
        raise ValueError(f"not a clock time: {text!r}")
    return (int(found[1]) % 12 + 12 * (found[3] == "P")) * 3600 + int(found[2] or 0) * 60


def clock_seconds(value) -> int:
    """Seconds of a clock text, a time, or a number of hours from 0 to 24."""
    if isinstance(value, str):
        return parse_clock(value)
    if hasattr(value, "hour"):
        return value.hour * 3600 + value.minute * 60 + value.second
    if isinstance(value, bool) or not 0 <= value <= 24:
        raise ValueError(f"not an hour of the day: {value!r}")
    return round(value * 3600)


def parse_time_bin(text: str) -> tuple[int, int]:
    """(start, end) seconds of '6:30AM-9:00AM'; the end may be earlier, over midnight."""
    parts = text.replace("–", "-").split("-")
    if len(parts) != 2:
        raise ValueError(f"not a time bin: {text!r}")
    return parse_clock(parts[0]), parse_clock(parts[1])


def parse_window(window) -> tuple[int, int]:
    """(start, end) seconds of a text or of a pair of clock texts, times or hours."""
    if isinstance(window, str):
        return parse_time_bin(window)
    start, end = window
    return clock_seconds(start), clock_seconds(end)


def parse_weekday(day) -> int:
    """0 (Monday) to 6 of a name, an abbreviation of at least three letters' worth, or a number."""
    if isinstance(day, str):
        text = day.strip()
        if text.isdigit():
            day = int(text)
        else:
            for k, name in enumerate(DAYS):
                if text[:3].lower() == name[:3].lower():
                    return k
            raise ValueError(f"not a weekday: {day!r}")
    if isinstance(day, bool) or day != int(day) or not 0 <= day <= 6:
        raise ValueError(f"not a weekday: {day!r}")
    return int(day)


def day_scheme(scheme: dict | Iterable[str] | None) -> dict[int, str]:
    """Weekday to label: of the default groups, a mapping, or texts such as 'Friday-Monday'; the last that names a day holds."""
    if scheme is None:
        scheme = DAY_GROUPS
    out: dict[int, str] = {}
    if isinstance(scheme, dict):
        for label, days in scheme.items():
            if isinstance(label, int):  # weekday to label already
                out[label] = days
            else:
                out.update({parse_weekday(d): label for d in days})
        return out
    for text in scheme:
        ends = [parse_weekday(x) for x in text.replace("–", "-").split("-")]
        first, last = ends[0], ends[-1]
        for k in range((last - first) % 7 + 1):
            out[(first + k) % 7] = text
    return out


def moment(value: date, tz: str | None = None) -> datetime:
    """A day's or a time's wall-clock time; of a time with a zone, that in ``tz``."""
    if not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        return value
    if tz is None:
        raise ValueError(f"a bound with a zone needs the zone of the series: {value!r}")
    return value.astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def _moment(value, end: bool, tz: str | None = None) -> datetime:
    at = value if isinstance(value, date) else datetime.strptime(value, "%Y%m%d") if re.fullmatch(r"\d{8}", value) else datetime.fromisoformat(value)
    at = moment(at, tz)
    if end and (at.hour, at.minute, at.second, at.microsecond) == (0, 0, 0, 0):
        at += timedelta(days=1)  # the whole of the last day, by the calendar
    return at


def parse_period(period, tz: str | None = None) -> tuple[datetime, datetime]:
    """Half-open local (start, end) of a pair or of 'YYYYMMDD-YYYYMMDD'; an end at midnight takes in that day. Bounds with a zone are moved to ``tz``."""
    start, end = period.split("-") if isinstance(period, str) else period
    start, end = _moment(start, False, tz), _moment(end, True, tz)
    if end <= start:
        raise ValueError("a period must end after it starts")
    return start, end


def check_periods(before, after, tz: str | None = None) -> tuple[tuple[datetime, datetime], tuple[datetime, datetime]]:
    """Both periods parsed; they may touch but not overlap."""
    a, b = parse_period(before, tz), parse_period(after, tz)
    if a[0] < b[1] and b[0] < a[1]:
        raise ValueError("the periods overlap")
    return a, b


def default_periods(first: date, last: date, warmup: int = 7) -> tuple | None:
    """Two disjoint halves of the days after a warm-up, or None for a span of fewer than three days; the warm-up leaves two days at least."""
    span = (last - first).days
    if span < 2:
        return None
    start = first + timedelta(days=min(warmup, span - 2))
    middle = start + timedelta(days=max((last - start).days // 2, 1))
    return (start, middle - timedelta(days=1)), (middle, last)


def to_local(df: DataFrame, tz: str = "America/Denver", ts: str = "ts_utc") -> DataFrame:
    """Adds local_ts, local_date, dow (0 is Monday) and tod_sec of the zone's wall clock; ``ts`` counts as UTC."""
    # A generator of one row is a line that the optimiser moves nothing over: the zone is looked up once a row, however often local_ts is used.
    local = F.explode(F.array(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts).cast("timestamp_ntz"))))
    df = df.drop("local_ts").select("*", local.alias("local_ts"))
    return df.withColumns(
        {
            "local_date": F.to_date("local_ts"),
            "dow": F.weekday("local_ts"),
            "tod_sec": (F.hour("local_ts") * 3600 + F.minute("local_ts") * 60 + F.second("local_ts")).cast("int"),
        }
    )


def within(seconds: Column, start: int, end: int) -> Column:
    """Half-open membership; a later start means over midnight."""
    if start > end:
        return (seconds >= start) | (seconds < end)
    return (seconds >= start) & (seconds < end)


def floor_seconds(minutes: int) -> Column:
    """The start of each row's slot of the day, in seconds; never ambiguous when clocks change."""
    width = 60 * minutes
    return (F.floor(F.col("tod_sec") / width) * width).cast("int")
