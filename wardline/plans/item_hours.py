"""Distinct ports, protocols and scan codes of any window from stored hours.

Counts of distinct items don't add up over hours, so the table keeps the items themselves, as
bitmaps of 32,768 numbers: one row per host, hour, metric, label (the protocol, where there is
one) and page of numbers. Bitmaps of several hours are combined by OR, and the result is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.payload import contacted_port, detected_protocol, scan_codes
from wardline.functions.risk import has_any_bit
from wardline.functions.timewin import HOUR, Window, hour_bucket, in_windows, laid_out_by_day, merged, whole_hour
from wardline.inputs import MetricInputs
from wardline.operators import flow_alerts, host_alerts, verdicts
from wardline.params import RiskParams
from wardline.plans.profile import with_partitions
from wardline.sources.tables import path_exists

PAGE = 32768  # numbers of one bitmap, as Spark's bitmap functions lay them out
SCHEMA = ("host_ip string, bucket timestamp, metric string, label string, page long, items binary, hits long, "
          "dt date, hh int")
#: What the hours hold of each metric.
ITEM = {"M_srv": "CAST(number AS STRING)", "M_proto": flow_alerts.COMBINATION.replace("{0}.proto", "label").replace(
    "{0}.port", "number"), "M_scan": "CAST(number AS STRING)"}


def _numbered(inputs: MetricInputs, p: RiskParams, *windows: Window) -> DataFrame:
    """(host_ip, at, metric, label, number): one row per item of an alert that a metric counts."""
    alerts = host_alerts.port_or_scan_alerts(in_windows(inputs.host_alerts, "tstamp", *windows), p)
    ports = alerts.filter(f"alert_id = {p.srv_alert_id}").select(
        "host_ip", F.col("tstamp").alias("at"), F.lit("M_srv").alias("metric"), F.lit("").alias("label"),
        contacted_port("json").cast("long").alias("number"))
    attacks = alerts.filter(f"alert_id = {p.scan_alert_id}").withColumn("codes", scan_codes("json")).filter(
        verdicts.scan_rank("codes") > 0)
    codes = attacks.select(
        "host_ip", F.col("tstamp").alias("at"), F.lit("M_scan").alias("metric"), F.lit("").alias("label"),
        F.explode(F.array_distinct("codes").cast("array<bigint>")).alias("number"))
    flows = flow_alerts.tls_or_port_alerts(in_windows(inputs.flow_alerts, "tstamp", *windows), p).filter(
        has_any_bit("flow_risk_bitmap", p.bit_nonstandard_port))
    protocols = flows.select(
        "host_ip", F.col("tstamp").alias("at"), F.lit("M_proto").alias("metric"), detected_protocol("json").alias("label"),
        F.col("srv_port").cast("long").alias("number"))
    return reduce(DataFrame.union, (ports, codes, protocols))


def hourly_items(inputs: MetricInputs, p: RiskParams, *windows: Window) -> DataFrame:
    """The items of every host and hour as bitmaps, with the number of alerts; a NULL number counts as no item."""
    key = ["host_ip", "bucket", "metric", "label"]
    seen = (  # equal items meet first, so a busy host sends one row for each of them
        _numbered(inputs, p, *windows).withColumn("bucket", hour_bucket("at", p))
        .groupBy(*key, "number").agg(F.count(F.lit(1)).alias("hits"))
    )
    return seen.groupBy(*key, F.coalesce(F.bitmap_bucket_number("number"), F.lit(0).cast("long")).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("items"), F.sum("hits").alias("hits"))


def write_item_hours(inputs: MetricInputs, path: str, p: RiskParams, window: tuple[int, int]) -> None:
    """Store the items of whole hours. Every hour of the window is replaced, so a job may run again; empty ones are noted."""
    if any(edge != whole_hour(edge, p) for edge in window):
        raise ValueError("items are stored in whole hours")
    covered = inputs.flows.sparkSession.range(*window, HOUR).selectExpr(
        "CAST(NULL AS STRING) AS host_ip", "timestamp_seconds(id) AS bucket", "'' AS metric", "'' AS label", "0L AS page",
        "CAST(NULL AS BINARY) AS items", "0L AS hits")
    (
        with_partitions(hourly_items(inputs, p, window).unionByName(covered)).hint("rebalance", "dt", "hh")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "hh").parquet(path)
    )


def items_of_window(spark: SparkSession, path: str, inputs: MetricInputs, p: RiskParams, window: tuple[int, int]) -> DataFrame:
    """(host_ip, metric, label, page, items, hits) of a window: stored hours combined, and raw alerts for what they miss.

    Raw alerts are read for the parts of hours at the edges of the window and for whole hours that were never stored.
    """
    start, end = window
    first, last = whole_hour(start + HOUR - 1, p), whole_hour(end, p)
    key = ["host_ip", "metric", "label", "page"]
    raw, parts = [(start, min(first, end)), (max(last, start), end)], []
    if first < last and path_exists(spark, path):
        stored = in_windows(laid_out_by_day(spark.read.schema(SCHEMA).parquet(path), "bucket", "dt"), "bucket", (first, last))
        known = {r[0] for r in stored.filter("host_ip IS NULL").selectExpr("unix_seconds(bucket)").distinct().collect()}
        raw += [(at, at + HOUR) for at in range(first, last, HOUR) if at not in known]
        hours = merged((at, at + HOUR) for at in known)
        parts.append(in_windows(stored, "bucket", *hours).filter("host_ip IS NOT NULL").select(*key, "items", "hits"))
    else:
        raw.append((first, last))
    if raw := merged(raw):
        parts.append(hourly_items(inputs, p, *raw).select(*key, "items", "hits"))
    return reduce(DataFrame.union, parts).groupBy(*key).agg(
        F.bitmap_or_agg("items").alias("items"), F.sum("hits").alias("hits"))


def distinct_items(items: DataFrame) -> DataFrame:
    """(host_ip, metric, distinct, hits): exact numbers of distinct items and of alerts."""
    return items.groupBy("host_ip", "metric").agg(
        F.sum(F.bitmap_count("items")).alias("distinct"), F.sum("hits").alias("hits"))


def listed_items(items: DataFrame) -> DataFrame:
    """(host_ip, metric, item): the items themselves, as host_items names them."""
    # Only bytes with a bit set are taken apart.
    bits = items.select("host_ip", "metric", "label", "page", F.posexplode(F.expr(
        "transform(sequence(1, octet_length(items)), i -> conv(hex(substring(items, i, 1)), 16, 10))")).alias("byte", "set"))
    numbers = (
        bits.filter("`set` <> '0'").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
        .filter(F.expr("shiftright(CAST(`set` AS INT), bit) & 1 = 1"))
        .withColumn("position", F.expr("byte * 8L + bit"))
        .withColumn("number", F.expr(f"CASE WHEN page > 0 THEN (page - 1) * {PAGE} + position + 1 ELSE page * {PAGE} - position END"))
    )
    return numbers.select("host_ip", "metric", F.expr(
        "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ITEM.items()) + " END").alias("item"))
