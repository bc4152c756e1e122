"""The deterministic metrics as streams: hourly windows in event time, closed by a watermark.

Rows are counted per window, host and item in Spark's state store. A window closes when the
watermark passes its end; its groups then leave the state and are appended to a table, from
which the verdicts of that window follow at once. Rows that come later than the watermark
allows can't change a closed window. They are not lost in silence: every batch also notes
how many rows have arrived for each window, and late_rows tells what was too late.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.ip import ipv4_to_string
from wardline.operators import flow_alerts, flow_metrics, host_alerts, verdicts
from wardline.operators.verdicts import Verdict, by_window
from wardline.params import RiskParams
from wardline.sources.tables import path_exists
from wardline.streaming.profile_stream import require_known_batches


#: Files that a batch writes of a day of closed windows, at most; of its arrivals it writes one.
FILES_A_DAY = 16


@dataclass(frozen=True)
class Family:
    """Metrics that share rows: which rows count, under which keys, and how verdicts follow from the counts."""

    name: str
    ts: str
    rows: Callable[[DataFrame, RiskParams], DataFrame]
    keys: Callable[[RiskParams], list[Column]]
    counts: Callable[[RiskParams], list[Column]]
    measures: Callable[[DataFrame, RiskParams], DataFrame]
    rules: Callable[[RiskParams], list[Verdict]]


def _blacklisted(flows: DataFrame, p: RiskParams) -> DataFrame:
    return flow_metrics.blacklisted(flows, p).withColumn("host_ip", ipv4_to_string("IPV4_SRC_ADDR"))


REPUTATION = Family(
    "reputation", "FIRST_SEEN", _blacklisted, lambda p: [], lambda p: flow_metrics.blacklist_counts(),
    lambda groups, p: groups, lambda p: [verdicts.reputation(p)])
ALERTED_FLOWS = Family(
    "alerted_flows", "tstamp", flow_alerts.tls_or_port_alerts,
    lambda p: [flow_alerts.alert_groups(p)[0]], lambda p: flow_alerts.alert_groups(p)[1], flow_alerts.alert_measures,
    lambda p: [verdicts.certificate(p), verdicts.missing_sni(p), verdicts.protocol_mismatch(p)])
HOST_ALERTS = Family(
    "host_alerts", "tstamp", host_alerts.port_or_scan_alerts, host_alerts.host_alert_groups,
    lambda p: [F.count(F.lit(1)).alias("alerts")], host_alerts.host_alert_measures,
    lambda p: [verdicts.server_ports(p, "srv_hits"), verdicts.scan(p, "scan_hits")])


def stream_family(rows: DataFrame, family: Family, path: str, checkpoint: str, p: RiskParams,
                  delay: str = "10 minutes", available_now: bool = True, stream: str = "all") -> StreamingQuery:
    """Count the rows of a stream per window of `alert_window_minutes`, and append the windows that close to `path`.

    The watermark is the latest instant among the rows that the family counts, less `delay`; so a
    window closes with the first counted row that is that much later than its end. Windows still open stay
    in the checkpoint and go on with the next run. A batch replaces its own part of the table, so one
    that is replayed after a failure counts once; a checkpoint that doesn't know the batches of a table is refused.
    """
    require_known_batches(rows.sparkSession, path, checkpoint, stream)
    window = F.window(F.col(family.ts), f"{p.alert_window_minutes} minutes")
    counted = family.rows(rows, p).withWatermark(family.ts, delay)
    closed = (
        counted.groupBy(window.alias("window"), "host_ip", *family.keys(p))
        .agg(*family.counts(p), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("ref", F.col("window.end")).drop("window").withColumn("kind", F.lit("closed"))
    )
    arrived = family.rows(rows, p).select(
        window["end"].alias("ref"), F.lit("arrived").alias("kind"), F.lit(1).cast("long").alias("n_rows"))

    def append(batch: DataFrame, batch_id: int) -> None:
        # Arrivals are one row per window and task before they are sent on; closed groups are few by then.
        shape = [c for c in batch.columns if c != "n_rows"]
        summed = batch.groupBy(*shape).agg(F.sum("n_rows").alias("n_rows"))
        # A day is dealt to a few tasks by host and window; else every task of the shuffle writes a file of each day.
        part = F.when(F.col("kind") == "closed", F.pmod(F.xxhash64("host_ip", "ref"), F.lit(FILES_A_DAY)))
        (
            summed.withColumns({"stream": F.lit(stream), "batch": F.lit(batch_id), "dt": F.to_date("ref")})
            .repartition("kind", "dt", part)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("kind", "dt", "stream", "batch").parquet(path)
        )

    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (
        closed.unionByName(arrived, allowMissingColumns=True).writeStream.foreachBatch(append)
        .outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    return spark.read.parquet(path).filter(F.col("kind") == kind)


def closed_windows(spark: SparkSession, family: Family, path: str, p: RiskParams,
                   since: int | None = None) -> dict[str, DataFrame]:
    """Per metric of the family: one row for each host that fires in a closed window, `ref` being the window's end.

    The columns are those of the metric in batch. `since` leaves out windows that end before an epoch. Several
    streams into one table add up.
    """
    groups = _stored(spark, path, "closed")
    if groups is None:
        return {}
    if since is not None:
        groups = groups.filter(f"dt >= to_date(timestamp_seconds({since})) AND ref >= timestamp_seconds({since})")
    keys = [c for c in groups.columns if c in ("combination", "alert_id", "port", "codes")]
    counts = [c for c in groups.columns if c not in (*keys, "kind", "dt", "stream", "batch", "ref", "host_ip", "n_rows")]
    # One subject is a host in a window; the batch measures then need not know of windows.
    subject = F.struct("ref", F.col("host_ip").alias("ip")).alias("host_ip")
    groups = groups.groupBy(subject, *keys).agg(*[F.sum(c).alias(c) for c in counts])
    measures = family.measures(groups, p)
    return {rule.key: by_window(rule.flagged(measures)) for rule in family.rules(p)}


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """(ref, arrived, late) for every closed window that has missed rows: those came after the watermark.

    Windows still open have no row, as theirs may yet be counted; a window that closed before any of its
    rows came counts as missed once a later window has closed.
    """
    counted, arrived = _stored(spark, path, "closed"), _stored(spark, path, "arrived")
    if arrived is None:
        return spark.createDataFrame([], "ref timestamp, arrived long, late long")
    counted = counted.groupBy("stream", "ref").agg(F.sum("n_rows").alias("counted"))
    closed = counted.groupBy("stream").agg(F.max("ref").alias("until"))
    arrived = arrived.groupBy("stream", "ref").agg(F.sum("n_rows").alias("arrived"))
    return (
        arrived.join(closed, "stream").filter("ref <= until").join(counted, ["stream", "ref"], "left")
        .groupBy("ref").agg(F.sum("arrived").alias("arrived"),
                            F.sum(F.expr("arrived - coalesce(counted, 0)")).alias("late"))
        .filter("late > 0")
    )
