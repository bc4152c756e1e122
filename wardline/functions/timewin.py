"""Instants, half-open windows, hour buckets and the time category of an instant."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.params import RiskParams

HOUR = 3600
DAY = 24 * HOUR
PARTITION_COLUMN = "dt"
DAY_OF = "wardline.day_of"  # column metadata: whose date a partition column holds

# Names of the three time categories.
WEEKEND = "weekend"
WORKING = "feriale_lavorativo"
OFF_HOURS = "feriale_fuoriorario"

Window = tuple[int, int | None]  # [start, end) in epoch seconds; None is an open end


def instant(epoch: int) -> str:
    return f"timestamp_seconds({epoch})"


def _inside(ts: str, window: Window) -> str:
    start, end = window
    lower = f"{ts} >= {instant(start)}"
    return f"({lower})" if end is None else f"({lower} AND {ts} < {instant(end)})"


def _day_inside(day: str, window: Window) -> str:
    start, end = window
    lower = f"`{day}` >= to_date({instant(start)})"
    return f"({lower})" if end is None else f"({lower} AND `{day}` <= to_date({instant(end - 1)}))"


def between_any(ts: str, windows) -> Column:
    parts = merged(windows)
    return F.expr(" OR ".join(_inside(ts, window) for window in parts)) if parts else F.lit(False)


def laid_out_by_day(df: DataFrame, ts: str, day: str | None) -> DataFrame:
    """Declare that the column `day` of df is the UTC date of `ts`; None declares nothing.

    Only such a column is used to skip days. Any other, whatever its name, may hold another date.
    """
    if day is None or day not in df.columns:
        return df
    return df.withMetadata(day, {**df.schema[day].metadata, DAY_OF: ts})


def day_column(df: DataFrame, ts: str) -> str | None:
    return next((f.name for f in df.schema.fields if f.metadata.get(DAY_OF) == ts), None)


def between(ts: str, window: Window) -> Column:
    return F.expr(_inside(ts, window))


def in_windows(df: DataFrame, ts: str, *windows: Window) -> DataFrame:
    """Rows inside any of the windows.

    A table declared to be laid out by day carries the date as a partition column;
    naming it in the predicate lets Spark skip whole days, which it cannot derive
    from the timestamp alone.
    """
    windows = merged(windows)
    if not windows:
        return df.filter("false")
    if day := day_column(df, ts):
        df = df.filter(" OR ".join(_day_inside(day, window) for window in windows))
    return df.filter(" OR ".join(_inside(ts, window) for window in windows))


def merged(windows) -> list[Window]:
    """The same instants as disjoint windows in order; empty ones go."""
    joined: list[Window] = []
    for start, end in sorted(windows, key=lambda w: w[0]):
        if end is not None and end <= start:
            continue
        if joined and (joined[-1][1] is None or start <= joined[-1][1]):
            before, last = joined[-1]
            joined[-1] = (before, None if last is None or end is None else max(last, end))
        else:
            joined.append((start, end))
    return joined


def whole_hour(epoch: int, p: RiskParams) -> int:
    """The start of the local hour that holds an instant."""
    offset = datetime.fromtimestamp(epoch, ZoneInfo(p.local_tz)).utcoffset()
    return epoch - (epoch + int(offset.total_seconds())) % HOUR


def category_of(epoch: int, p: RiskParams) -> str:
    """The time category of an instant, worked out on the driver."""
    local = datetime.fromtimestamp(epoch, timezone.utc).astimezone(ZoneInfo(p.local_tz))
    if local.isoweekday() in p.weekend_days:
        return WEEKEND
    first, last = p.working_hours
    return WORKING if first <= local.hour <= last else OFF_HOURS


def category_windows(p: RiskParams, window: tuple[int, int] | None = None) -> list[Window]:
    """The parts of the history window, or of another, in the time category of the reference.

    A few intervals a week: they tell the reader which days and hours to skip, which a
    condition on the category of each row can't.
    """
    start, end = window or history_window(p)
    wanted, parts, at = category_of(p.flows_epoch, p), [], start
    while at < end:
        following = min(whole_hour(at, p) + HOUR, end)
        if category_of(at, p) == wanted:
            parts.append((at, following))
        at = following
    return merged(parts)


def _local(ts: str, p: RiskParams) -> str:
    return ts if p.local_tz == "UTC" else f"from_utc_timestamp({ts}, '{p.local_tz}')"


def hour_bucket(ts: str, p: RiskParams) -> Column:
    """Start of the local hour of ts, as an instant."""
    if p.local_tz == "UTC":
        return F.expr(f"date_trunc('hour', {ts})")
    return F.expr(
        f"timestamp_seconds(unix_seconds({ts}) - pmod(unix_seconds({_local(ts, p)}), {HOUR}))")


def time_category(ts: str, p: RiskParams) -> Column:
    local = _local(ts, p)
    days = ", ".join(map(str, p.weekend_days)) or "NULL"
    first, last = p.working_hours
    return F.expr(
        f"CASE WHEN weekday({local}) + 1 IN ({days}) THEN '{WEEKEND}'"
        f" WHEN hour({local}) BETWEEN {first} AND {last} THEN '{WORKING}'"
        f" ELSE '{OFF_HOURS}' END")


def reference_category(p: RiskParams) -> Column:
    return time_category(instant(p.flows_epoch), p)


def current_window(p: RiskParams) -> tuple[int, int]:
    return p.flows_epoch - p.current_window_hours * HOUR, p.flows_epoch


def history_window(p: RiskParams) -> tuple[int, int]:
    return p.flows_epoch - p.history_days * DAY, p.flows_epoch - p.current_window_hours * HOUR


def alert_window(p: RiskParams, minutes: int | None = None) -> tuple[int, int]:
    return p.flows_epoch - _minutes(p, minutes) * 60, p.flows_epoch


def host_alert_window(p: RiskParams, minutes: int | None = None) -> Window:
    """Host alerts have no upper bound unless a past instant is replayed."""
    start = p.alerts_epoch - _minutes(p, minutes) * 60
    return start, p.alerts_epoch if p.replays_alerts else None


def _minutes(p: RiskParams, minutes: int | None) -> int:
    minutes = p.alert_window_minutes if minutes is None else minutes
    if minutes <= 0:
        raise ValueError("the window must be a positive number of minutes")
    return minutes
