"""Calendar columns over epoch milliseconds; none depends on the session zone."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Seoul"
LOCAL_OFFSET_MS = 9 * 3_600_000
DAY_MS = 86_400_000


def _epoch_day(ms: Column, offset_ms: int = 0) -> Column:
    return F.date_add(F.lit(date(1970, 1, 1)), F.floor((ms + offset_ms) / DAY_MS).cast("int"))


def ntz_millis(at: Column) -> Column:
    """Zone-free timestamp -> epoch milliseconds, read as UTC whatever the session zone."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", base, at) / 1000).cast("bigint")


def local_day(start_ms: Column) -> Column:
    return _epoch_day(start_ms, LOCAL_OFFSET_MS)


def event_date_utc(start_ms: Column, created_at: Column) -> Column:
    """UTC calendar date of the flow, else of its arrival, as text."""
    return F.coalesce(
        _epoch_day(start_ms).cast("string"), F.substring(created_at.cast("string"), 1, 10)
    )


def day_bounds(day: date | str, zone: str = LOCAL_ZONE) -> tuple[datetime, datetime]:
    day = date.fromisoformat(day) if isinstance(day, str) else day
    tz = ZoneInfo(zone)
    start = datetime.combine(day, time.min, tzinfo=tz)
    return start, datetime.combine(day + timedelta(days=1), time.min, tzinfo=tz)


def in_local_day(start_ms: Column, created_at: Column, day: date | str, zone: str = LOCAL_ZONE) -> Column:
    """Inside the local day by flow time; flows without one fall back to arrival time (UTC, NTZ)."""
    lo, hi = day_bounds(day, zone)
    lo_ms, hi_ms = int(lo.timestamp() * 1000), int(hi.timestamp() * 1000)
    utc = ZoneInfo("UTC")
    lo_utc = F.lit(lo.astimezone(utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    hi_utc = F.lit(hi.astimezone(utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    timed = (start_ms >= lo_ms) & (start_ms < hi_ms)
    untimed = start_ms.isNull() & (created_at >= lo_utc) & (created_at < hi_utc)
    return F.coalesce(timed, F.lit(False)) | F.coalesce(untimed, F.lit(False))


def row_time(start_ms: Column, created_at: Column) -> Column:
    """Local wall-clock text of the flow, else its arrival text, else 'unknown'."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    local = base + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), ((start_ms + LOCAL_OFFSET_MS) / 1000).cast("decimal(18,6)")
    )
    return F.coalesce(
        F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+09:00")),
        created_at.cast("string"),
        F.lit("unknown"),
    )
