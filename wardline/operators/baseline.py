"""Contextual baselines: hourly samples per host, their median and MAD, and the robust z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.ip import ipv4_to_string, is_external, is_local
from wardline.functions.risk import failure_causes, is_failed
from wardline.functions.text import CAUSE_LABELS
from wardline.functions.timewin import (
    alert_window, between_any, category_windows, current_window, hour_bucket, in_windows,
    reference_category, time_category,
)
from wardline.params import RiskParams


def robust_z(value: str, median: str, mad: str) -> str:
    """Signed distance from the median in units of MAD; NULL when the MAD is zero."""
    return f"try_divide({value} - {median}, {mad})"


def robust_stats(values: str) -> str:
    """struct(median, mad) of an array of numbers, both interpolated between the middle two.

    A one-element transform names an intermediate result, so that it is computed
    once and not at each of its uses.
    """
    def median(ordered: str) -> str:
        return f"(get({ordered}, (size({ordered}) - 1) DIV 2) + get({ordered}, size({ordered}) DIV 2)) / 2.0D"

    def named(value: str, name: str, result: str) -> str:
        return f"get(transform(array({value}), {name} -> {result}), 0)"

    distances = f"sort_array(transform({values}, x -> abs(x - mid)))"
    return named(
        named(f"sort_array({values})", "ordered", median("ordered")), "mid",
        named(distances, "spread", f"named_struct('median', mid, 'mad', {median('spread')})"))


def contextual_baseline(samples: DataFrame, key: str, values: dict[str, Column],
                        min_samples: int = 1) -> DataFrame:
    """Count, median and MAD of each value per key, in one pass.

    Samples are hourly roll-ups, so the collected list holds one number per
    hour of history and no more. NULL values are not samples.
    """
    lists = [F.collect_list(v).alias(f"{name}_list") for name, v in values.items()]
    grouped = samples.groupBy(key).agg(
        F.count(next(iter(values.values()))).alias("bucket_count"), *lists
    ).filter(F.col("bucket_count") >= min_samples)
    return with_stats(grouped, {name: f"{name}_list" for name in values}, key, "bucket_count")


def with_stats(df: DataFrame, lists: dict[str, str], *kept: str) -> DataFrame:
    """Median and MAD of array columns, next to the kept columns.

    The statistics are generated, not projected: later filters on them then use
    the computed values instead of computing them again.
    """
    stats = ", ".join(f"'{name}', {robust_stats(values)}" for name, values in lists.items())
    return df.selectExpr(*kept, f"inline(array(named_struct({stats})))").selectExpr(
        *kept, *[f"{name}.{s} AS {name}_{label}" for name in lists
                 for s, label in (("median", "mediana"), ("mad", "mad"))])


def same_category(ts: str, p: RiskParams) -> Column:
    """ts falls into the time category of the reference instant."""
    return time_category(ts, p) == reference_category(p)


def is_subject(p: RiskParams) -> Column:
    """The flow has an IPv4 source inside the monitored networks."""
    return F.expr("IPV4_SRC_ADDR != 0") & is_local("IPV4_SRC_ADDR", p)


def goes_outside(p: RiskParams) -> Column:
    return is_external("IPV4_DST_ADDR", p)


def hourly_profile(flows: DataFrame, p: RiskParams) -> DataFrame:
    """Bytes, flows and failed flows per host and hour, over all given flows."""
    return (
        flows.filter(is_subject(p) & goes_outside(p))
        .groupBy(F.col("IPV4_SRC_ADDR").alias("host"), hour_bucket("FIRST_SEEN", p).alias("bucket"))
        .agg(
            F.sum("SRC2DST_BYTES").alias("bytes_out"),
            F.count(F.lit(1)).alias("flows"),
            F.count_if(is_failed(p)).alias("failed"),
        )
    )


def host_hour(flows: DataFrame, p: RiskParams) -> DataFrame:
    """The hourly samples of the baseline: history window, category of the reference."""
    return hourly_profile(in_windows(flows, "FIRST_SEEN", *category_windows(p)), p)


def slices_of(flows: DataFrame, p: RiskParams, with_reputation: bool, past: list | None = None) -> DataFrame:
    """One row per (host, history hour), plus one per host with a NULL bucket for the rest.

    The NULL bucket carries the sums of the current window and, if wanted, the
    blacklist hits of the alert window. Only partial sums leave the map side, so
    a host that owns most flows still shuffles just a few rows per task.
    `past` are the windows of the history, by default its parts in the category of the reference.
    """
    ts = "FIRST_SEEN"
    past = between_any(ts, category_windows(p) if past is None else past)
    subjects = flows.filter(is_subject(p))
    if with_reputation:
        recent = between_any(ts, [alert_window(p)])
    else:
        subjects, recent = subjects.filter(goes_outside(p)), F.lit(False)
    kept = (
        subjects
        .withColumns({"outside": goes_outside(p), "recent": recent})
        .withColumns({
            "now": F.col("outside") & between_any(ts, [current_window(p)]),
            "past": F.col("outside") & past,
            "srv": F.expr("recent AND IS_SRV_BLACKLISTED = 1"),
            "cli": F.expr("recent AND IS_CLI_BLACKLISTED = 1"),
            "failing": is_failed(p),
            "hour": hour_bucket(ts, p),
            **failure_causes(p),
        })
        .filter("now OR past OR srv OR cli")
    )
    return kept.groupBy(
        F.col("IPV4_SRC_ADDR").alias("host"), F.expr("CASE WHEN past THEN hour END AS bucket")
    ).agg(
        F.expr("sum(CASE WHEN now OR past THEN SRC2DST_BYTES END) AS bytes_out"),
        F.expr("count_if(now OR past) AS flows"),
        F.expr("count_if((now OR past) AND failing) AS failed"),
        *[F.expr(f"count_if(now AND {cause}) AS n_{cause}") for cause in CAUSE_LABELS],
        F.expr("count_if(srv) AS hits_srv"),
        F.expr("count_if(cli) AS hits_cli"),
    )


def host_slices(flows: DataFrame, p: RiskParams, with_reputation: bool = False) -> DataFrame:
    """History samples and current sums of every host from a single scan of the flows."""
    windows = [*category_windows(p), current_window(p)]
    if with_reputation:
        windows.append(alert_window(p))
    return slices_of(in_windows(flows, "FIRST_SEEN", *windows), p, with_reputation)


SAMPLES = {
    "v": "CASE WHEN bucket IS NOT NULL THEN bytes_out END",
    "r": "CASE WHEN bucket IS NOT NULL THEN CAST(failed AS DOUBLE) / flows END",
}


def summarise(slices: DataFrame, p: RiskParams, *values: str) -> DataFrame:
    """One row per host: current sums next to the baseline, without a join.

    `values` names the baselines wanted: v for the volume, r for the failure rate.
    A host has one slice per hour of history, and collecting them makes nothing
    smaller before the shuffle: so the slices themselves are sent to their host,
    once, and the aggregation needs no further exchange.
    """
    current = {"v_out": "bytes_out", "n_totali": "flows", "n_falliti": "failed"}
    always = [*[f"n_{cause}" for cause in CAUSE_LABELS], "hits_srv", "hits_cli"]
    grouped = slices.repartition("host").groupBy("host").agg(
        *[F.expr(f"coalesce(sum(CASE WHEN bucket IS NULL THEN {c} END), 0) AS {name}")
          for name, c in current.items()],
        *[F.expr(f"sum({c}) AS {c}") for c in always],
        F.expr("count(bucket) AS bucket_baseline"),
        *[F.expr(f"collect_list({SAMPLES[v]}) AS {v}_list") for v in values],
    ).withColumns({
        "host_ip": ipv4_to_string("host"),
        "categoria_temporale": reference_category(p),
    })
    return with_stats(grouped, {v: f"{v}_list" for v in values},
                      "host_ip", *current, *always, "bucket_baseline", "categoria_temporale")


def host_activity(flows: DataFrame, p: RiskParams, *values: str, with_reputation: bool = False) -> DataFrame:
    """Current sums and the wanted baselines of every host, straight from the flows."""
    return summarise(host_slices(flows, p, with_reputation), p, *values)
