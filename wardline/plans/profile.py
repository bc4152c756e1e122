"""The hourly profile as a stored table, so that a run scans an hour and not a week.

A profile row is the sum of one host's outgoing flows in one hour. A run needs
the raw flows only for the current window and for the hours that the ends of the
history window cut in two.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions.text import CAUSE_LABELS
from wardline.functions.timewin import (
    HOUR, Window, alert_window, category_windows, current_window, history_window, hour_bucket, in_windows, laid_out_by_day,
    merged, whole_hour,
)
from wardline.inputs import MetricInputs
from wardline.operators.baseline import host_activity, hourly_profile, slices_of, summarise
from wardline.params import RiskParams

DAY_AND_HOUR = ("dt", "hh")
# Column metadata of `bucket`: the table that also shows hours without flows; windows that are covered, flows or not.
STORED_AT, COVERS = "wardline.stored_at", "wardline.covers"


def covering(profile: DataFrame, *windows: tuple[int, int]) -> DataFrame:
    """Declare that the profile holds all flows of the windows, so that hours without a row were idle."""
    known = {**profile.schema["bucket"].metadata}
    known[COVERS] = json.dumps(merged([*json.loads(known.get(COVERS, "[]")), *windows]))
    return profile.withMetadata("bucket", known)


def profile_of(flows: DataFrame, p: RiskParams, window: tuple[int, int]) -> DataFrame:
    """The hourly profile of flows that are complete in a window, computed and not stored."""
    return covering(hourly_profile(in_windows(flows, "FIRST_SEEN", window), p), window)


def with_partitions(profile: DataFrame) -> DataFrame:
    return profile.withColumn("dt", F.to_date("bucket")).withColumn("hh", F.hour("bucket"))


def write_profile(flows: DataFrame, path: str, p: RiskParams, window: tuple[int, int]) -> None:
    """Roll up the flows of whole hours into the stored profile.

    Every hour of the window is replaced, also one that has no flows any more: each gets a row
    without a host, which read_profile leaves out, and which shows uncovered_hours that the hour is covered.
    """
    if any(edge != whole_hour(edge, p) for edge in window):
        raise ValueError("the profile is written in whole hours")
    start, end = window
    hours = flows.sparkSession.range(start, end, HOUR).selectExpr(
        "CAST(NULL AS BIGINT) AS host", "timestamp_seconds(id) AS bucket", "0L AS bytes_out", "0L AS flows", "0L AS failed")
    write_profile_rows(hourly_profile(in_windows(flows, "FIRST_SEEN", window), p).unionByName(hours), path)


def write_profile_rows(profile: DataFrame, path: str) -> None:
    """Replace just the hours present in `profile`, so a retried run is safe.

    An hour of which `profile` has no row is left as it is; write_profile replaces a whole window.
    """
    (
        with_partitions(profile)
        .hint("rebalance", *DAY_AND_HOUR)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*DAY_AND_HOUR).parquet(path)
    )


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema(schemas.PROFILE).parquet(path).filter("host IS NOT NULL")
    stored = stored.withMetadata("bucket", {**stored.schema["bucket"].metadata, STORED_AT: path})
    return laid_out_by_day(stored, "bucket", "dt")


def _hours(rows: DataFrame) -> set[int]:
    """The hours that occur in a column `bucket`: at most those of the history."""
    return {row[0] for row in rows.selectExpr("unix_seconds(bucket)").distinct().collect()}


def _missing(windows: list[Window], p: RiskParams, covered: set[int], complete=()) -> list[Window]:
    """The hours of the windows that are neither among the covered ones nor inside a complete window."""
    missing, complete = [], merged(map(tuple, complete))
    for at, end in windows:
        while at < end:
            following = min(whole_hour(at, p) + HOUR, end)
            if at not in covered and not any(a <= at and following <= b for a, b in complete):
                missing.append((at, following))
            at = following
    return merged(missing)


def uncovered_hours(profile: DataFrame, p: RiskParams) -> list[Window]:
    """The whole hours that the baselines compare and that the profile doesn't cover.

    Covered are hours that have a row, those of a stored table that were written without flows, and those that the profile
    is declared to cover.
    """
    known = profile.schema["bucket"].metadata
    complete = json.loads(known.get(COVERS, "[]"))
    windows = _missing(category_windows(p, whole_hours(p)), p, set(), complete)
    if not windows:
        return []
    if path := known.get(STORED_AT):
        stored = profile.sparkSession.read.schema(schemas.PROFILE).parquet(path)
        profile = laid_out_by_day(stored, "bucket", "dt")
    return _missing(windows, p, _hours(in_windows(profile, "bucket", *windows)))


def require_history(profile: DataFrame, flows: DataFrame, p: RiskParams, flows_cover=()) -> list[Window]:
    """The hours to read from raw flows; hours that neither has are refused, as baselines would silently miss them.

    `flows_cover` are windows in which the raw flows are complete: an hour without flows was idle there. Elsewhere an
    hour without flows may be idle or lost, which nobody can tell from the flows. A profile without a single row in
    the history window is refused unless it covers all of it.
    """
    gaps = uncovered_hours(profile, p)
    if not gaps:
        return gaps
    first, last = whole_hours(p)
    lost = _missing(gaps, p, set(), flows_cover)
    if not lost:
        return gaps
    if in_windows(profile, "bucket", (first, last)).isEmpty():
        raise ValueError("the profile has no row in the history window; leave it out to read raw flows")
    raw = in_windows(flows, "FIRST_SEEN", *lost).select(hour_bucket("FIRST_SEEN", p).alias("bucket"))
    if lost := _missing(lost, p, _hours(raw)):
        raise ValueError(
            f"neither the profile nor the raw flows cover {sum(b - a for a, b in lost) // HOUR} hours of the history, the "
            f"first at epoch {lost[0][0]}; if the network was idle then, say so: write_profile and compact store hours without "
            "flows, covering declares them for a profile, and flows_cover for the raw flows of the inputs")
    return gaps


def activity_of(inputs: MetricInputs, p: RiskParams, *values: str, with_reputation: bool = False) -> DataFrame:
    """Current sums and baselines of every host, from the stored profile if the inputs have one."""
    if inputs.profile is None:
        return host_activity(inputs.flows, p, *values, with_reputation=with_reputation)
    gaps = inputs.profile_gaps
    if gaps is None:
        gaps = require_history(inputs.profile, inputs.flows, p, inputs.flows_cover)
    return host_activity_from_profile(
        inputs.profile, inputs.flows, p, *values, with_reputation=with_reputation, gaps=gaps)


def whole_hours(p: RiskParams) -> tuple[int, int]:
    """The part of the history window made of whole hours."""
    start, end = history_window(p)
    return whole_hour(start + HOUR - 1, p), whole_hour(end, p)


def host_activity_from_profile(profile: DataFrame, flows: DataFrame, p: RiskParams, *values: str,
                               with_reputation: bool = False, gaps: list[Window] | None = None) -> DataFrame:
    """The same rows as the direct scan, from stored hours plus the raw flows they miss.

    `gaps` are the hours that the profile doesn't cover, looked up if not given.

    `profile` holds one row per host and hour, as write_profile stores it, and
    so needs no shuffle of its own here. Partial sums of a stream go through
    merged_profile first.
    """
    past_start, past_end = history_window(p)
    first, last = whole_hours(p)
    edges = [*category_windows(p, (past_start, min(first, past_end))), *category_windows(p, (max(last, past_start), past_end))]
    edges += uncovered_hours(profile, p) if gaps is None else gaps
    raw_windows = [*edges, current_window(p)]
    if with_reputation:
        raw_windows.append(alert_window(p))
    raw = in_windows(flows, "FIRST_SEEN", *raw_windows)
    recent = slices_of(raw, p, with_reputation, past=edges)
    extra = [*[f"n_{cause}" for cause in CAUSE_LABELS], "hits_srv", "hits_cli"]
    stored = (
        in_windows(profile, "bucket", *category_windows(p, (first, last))).filter("host IS NOT NULL")
        .selectExpr("host", "bucket", "bytes_out", "flows", "failed", *[f"0L AS {c}" for c in extra])
    )
    return summarise(stored.unionByName(recent), p, *values)
