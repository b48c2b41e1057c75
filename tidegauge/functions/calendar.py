"""Calendar and geometry expressions over zone-free timestamps."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hour_floor(ts) -> Column:
    """Start of the hour, still without a zone."""
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


def day_floor(ts) -> Column:
    return F.date_trunc("day", _c(ts)).cast("timestamp_ntz")


def weekday(ts) -> Column:
    """Monday is 0."""
    return F.weekday(_c(ts))


def season(ts) -> Column:
    return (F.floor((F.month(_c(ts)) % 12) / 3) + 1).cast("int")


def is_night(ts, start: int = 22, end: int = 5) -> Column:
    """Hours from `start` through midnight to `end`, both included."""
    return (F.hour(_c(ts)) >= start) | (F.hour(_c(ts)) <= end)


def is_weekend(ts) -> Column:
    return weekday(ts) >= 5


def is_commute(ts, bands=((7, 9), (17, 19)), workdays_only: bool = True) -> Column:
    """Hours in either band, ends included; on working days alone unless told otherwise."""
    hit = F.lit(False)
    for low, high in bands:
        hit = hit | F.hour(_c(ts)).between(low, high)
    return hit & ~is_weekend(ts) if workdays_only else hit


def minutes_between(start, end) -> Column:
    """Fractional minutes, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(6e7)


def haversine_km(lat, lon, lat0: float, lon0: float) -> Column:
    """Great-circle distance to a fixed place."""
    d_lat, d_lon = F.radians(_c(lat) - lat0), F.radians(_c(lon) - lon0)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(_c(lat))) * F.pow(F.sin(d_lon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def parse_stamp(text, pattern: str = "yyyyMMdd_HHmmss") -> Column:
    return F.try_to_timestamp(_c(text), F.lit(pattern))


def iso_seconds(ts) -> Column:
    """ISO 8601 with the session zone's offset, to the second."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ssXXX")


def in_zone(ts, zone: str, of: str = "UTC") -> Column:
    """A zone-free timestamp of one zone as one of another."""
    return F.convert_timezone(F.lit(of), F.lit(zone), _c(ts))


def iso_in_zone(ts, zone: str) -> Column:
    """ISO 8601 to the second, with the offset, of a zone-free UTC timestamp in a zone."""
    local = in_zone(ts, zone)
    minutes = F.timestamp_diff("MINUTE", _c(ts), local)
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def cutoff(text: str) -> datetime:
    """A cutoff given as ISO 8601; one without a zone is an error."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("the cutoff needs a time zone")
    return at


def resolve_cutoff(configured: datetime | None, saved: dict, zone: str = "Asia/Seoul", key: str = "snapshot_cutoff_at") -> datetime | None:
    """The cutoff in a zone: the configured one, else the one a saved summary holds, else None. A saved one that can't be read or has no zone is none."""
    if configured is None:
        try:
            configured = cutoff(str(saved.get(key) or ""))
        except ValueError:
            return None
    return configured.astimezone(ZoneInfo(zone))
