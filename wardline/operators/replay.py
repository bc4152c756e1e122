"""Volume and failure rate for every hour of a range in one pass.

One run per instant would read the history once for every hour. Here each hourly sample is
sent to its host once; a range frame over the samples of a host and time category is the
history of an instant, and median and MAD follow from it row by row. So the shuffle holds
each sample once, however many instants are judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.ip import ipv4_to_string
from wardline.functions.risk import failure_causes, is_failed
from wardline.functions.text import CAUSE_LABELS
from wardline.functions.timewin import DAY, HOUR, hour_bucket, in_windows, time_category, whole_hour
from wardline.operators import verdicts
from wardline.operators.baseline import goes_outside, is_subject, robust_stats
from wardline.operators.verdicts import by_window
from wardline.params import RiskParams

CAUSES = [f"n_{cause}" for cause in CAUSE_LABELS]
SUMS = ("bytes_out", "flows", "failed", *CAUSES)


def hourly_causes(flows: DataFrame, p: RiskParams) -> DataFrame:
    """Bytes, flows, failed flows and their causes per host and hour."""
    causes = failure_causes(p)
    return (
        flows.filter(is_subject(p) & goes_outside(p))
        .groupBy(F.col("IPV4_SRC_ADDR").alias("host"), hour_bucket("FIRST_SEEN", p).alias("bucket"))
        .agg(F.sum("SRC2DST_BYTES").alias("bytes_out"), F.count(F.lit(1)).alias("flows"),
             F.count_if(is_failed(p)).alias("failed"),
             *[F.count_if(condition).alias(f"n_{cause}") for cause, condition in causes.items()])
    )


def _require_hours(p: RiskParams, start: int, end: int) -> None:
    if any(edge != whole_hour(edge, p) for edge in (start, end)):
        raise ValueError("instants are replayed at whole hours")


def rolling_baselines(hours: DataFrame, p: RiskParams, start: int, end: int) -> DataFrame:
    """Current sums next to the baseline of every host at every whole hour in [start, end).

    `hours` has a row per host and hour with SUMS, as hourly_causes gives them. A host has a row at the
    instants before which its current window has a flow, and at which its history has a
    sample in the category of the instant. Columns are the measures of M_vol and M_fail, with
    host_ip as a struct of `ref` and `ip`.
    """
    _require_hours(p, start, end)
    span, back = p.current_window_hours * HOUR, p.history_days * DAY
    category = time_category("at", p)
    # A sample serves as history under its own instant, and as part of the current sums under each instant that
    # its hour is within the window of. Both kinds go through one exchange, by host.
    roles = (
        hours.selectExpr("host", "unix_seconds(bucket) AS seconds", *SUMS)
        .repartition("host")
        .selectExpr("host", "seconds", *SUMS, f"explode(sequence(0, {p.current_window_hours})) AS ahead")
        .selectExpr("host", f"timestamp_seconds(seconds + ahead * {HOUR}) AS at", "ahead > 0 AS asks", *SUMS)
        .filter(f"NOT asks OR (at >= timestamp_seconds({start}) AND at < timestamp_seconds({end}))")
        .withColumn("categoria_temporale", category)
        .groupBy("host", "categoria_temporale", "at", "asks").agg(*[F.sum(c).alias(c) for c in SUMS])
    )
    samples = {"v": "CASE WHEN NOT asks THEN bytes_out END",
               "r": "CASE WHEN NOT asks THEN CAST(failed AS DOUBLE) / flows END"}
    history = (
        Window.partitionBy("host", "categoria_temporale").orderBy(F.expr("unix_seconds(at)"))
        .rangeBetween(-back, -span - 1)
    )
    judged = (
        roles.select("*", *[F.collect_list(F.expr(s)).over(history).alias(f"{v}_list") for v, s in samples.items()])
        .filter("asks AND size(v_list) > 0")
    )
    stats = ", ".join(f"'{v}', {robust_stats(f'{v}_list')}" for v in samples)
    return (
        judged.withColumn("ip", ipv4_to_string("host"))
        .selectExpr("struct(at AS ref, ip) AS host_ip", "bytes_out AS v_out", "flows AS n_totali", "failed AS n_falliti",
                    *CAUSES, "categoria_temporale", "CAST(size(v_list) AS BIGINT) AS bucket_baseline",
                    f"inline(array(named_struct({stats})))")
        .selectExpr("host_ip", "v_out", "n_totali", "n_falliti", *CAUSES, "categoria_temporale", "bucket_baseline",
                    *[f"{v}.{s} AS {v}_{label}" for v in samples for s, label in (("median", "mediana"), ("mad", "mad"))])
    )


def hourly_replay(flows: DataFrame, p: RiskParams, start: int, end: int, only_fired: bool = True) -> dict[str, DataFrame]:
    """M_vol and M_fail at every whole hour `ref` in [start, end), each as its batch metric gives it with flows_ref = ref.

    Only flows from the history of the first instant on are read, once for both.
    """
    _require_hours(p, start, end)
    reach = max(p.history_days * DAY, p.current_window_hours * HOUR)
    flows = in_windows(flows, "FIRST_SEEN", (start - reach, end - HOUR))
    measures = rolling_baselines(hourly_causes(flows, p), p, start, end)
    return {rule.key: by_window(rule.flagged(measures) if only_fired else rule.compared(measures))
            for rule in (verdicts.volume(p), verdicts.failure_rate(p))}
