"""Instants, zones and windows."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}
_LABELS = {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM"}


def bucket_label(ts: Column, bucket: str, zone: str = "UTC") -> Column:
    """Local day, the Monday of the local week, or local month of a UTC instant."""
    local = F.from_utc_timestamp(ts, zone)
    return F.date_format(F.date_trunc(bucket, local), _LABELS[bucket])


def in_window(ts: Column, since: Column | None, until: Column | None) -> Column:
    """[since, until): the end is left out. An unknown instant gives null under any bound, which a filter drops, so that scans see the plain comparison."""
    ok = F.lit(True)
    if since is not None:
        ok = ok & (ts >= since)
    if until is not None:
        ok = ok & (ts < until)
    return ok


def event_time(occurred: Column, observed: Column) -> Column:
    return F.coalesce(occurred, observed)


def utc_millis(iso: Column) -> Column:
    """Epoch milliseconds of ISO text; null where it is no instant."""
    return F.unix_millis(F.try_to_timestamp(iso))


def parse_point(text: str, now: datetime, zone: str = "UTC") -> datetime:
    """A duration before ``now`` (``7d``), a local date, or an ISO instant; raises for anything else."""
    text = text.strip()
    if m := re.fullmatch(r"(\d+)([mhdw])", text):
        return now - timedelta(seconds=int(m[1]) * _UNITS[m[2]])
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return local_midnight(date.fromisoformat(text), zone)
    return datetime.fromisoformat(text).astimezone(UTC)


def local_midnight(day: date, zone: str) -> datetime:
    """The first instant of a local date: where midnight is skipped, the end of the gap."""
    at = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).astimezone(UTC)
    while at.astimezone(ZoneInfo(zone)).date() < day:
        at += timedelta(minutes=15)
    return at
