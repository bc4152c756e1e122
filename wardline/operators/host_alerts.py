"""Metrics over host alerts: new server ports and network scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.ip import is_local_text
from wardline.functions.payload import contacted_port, scan_codes
from wardline.functions.text import scan_labels
from wardline.functions.timewin import Window as Window_, host_alert_window, in_windows
from wardline.inputs import MetricInputs
from wardline.operators import verdicts
from wardline.operators.lists import frequent_items
from wardline.params import RiskParams


def alerted_hosts(alerts: DataFrame, p: RiskParams, minutes: int | None, alert_id: int) -> DataFrame:
    """Alerts of one kind raised on local hosts in the window."""
    return in_windows(alerts, "tstamp", host_alert_window(p, minutes)).filter(
        F.expr(f"alert_id = {alert_id}") & is_local_text("ip", p)
    ).withColumnRenamed("ip", "host_ip")


def port_hits(alerts: DataFrame, p: RiskParams, minutes: int | None = None) -> DataFrame:
    """Alerts on new server ports per host and port."""
    return (
        alerted_hosts(alerts, p, minutes, p.srv_alert_id)
        .groupBy("host_ip", contacted_port("json").alias("port"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def ports(alerts: DataFrame, p: RiskParams, minutes: int | None = None) -> DataFrame:
    """Per host: alerts on new server ports, distinct ports, the frequent ones."""
    pairs = port_hits(alerts, p, minutes)
    totals = pairs.groupBy("host_ip").agg(
        F.sum("hits").alias("hits_totali"), F.count(F.lit(1)).alias("porte_distinte"))
    return totals.join(frequent_items(pairs, "port", p.list_limit, "lista_porte"), "host_ip")


def m_srv(inputs: MetricInputs, p: RiskParams, minutes: int | None = None) -> DataFrame:
    p = p.pinned()
    return verdicts.server_ports(p).flagged(ports(inputs.host_alerts, p, minutes))


def attacks(alerts: DataFrame, p: RiskParams, minutes: int | None = None) -> DataFrame:
    """Scan alerts per attacking host and set of codes, with their rank of severity."""
    groups = (
        alerted_hosts(alerts, p, minutes, p.scan_alert_id)
        .groupBy("host_ip", scan_codes("json").alias("codes"))
        .agg(F.count(F.lit(1)).alias("alerts"))
    )
    return groups.withColumn("severity", verdicts.scan_rank("codes")).filter("severity > 0")


def code_hits(found: DataFrame) -> DataFrame:
    """Scan alerts per host and code."""
    return (
        found.select("host_ip", F.explode(F.array_distinct("codes")).alias("code"), "alerts")
        .groupBy("host_ip", "code").agg(F.sum("alerts").alias("hits"))
    )


def scans(alerts: DataFrame, p: RiskParams, minutes: int | None = None) -> DataFrame:
    """Per attacking host: scan alerts, codes seen, worst penalty and its category."""
    found = attacks(alerts, p, minutes)
    # The largest rank is a number, so the aggregation stays a hash aggregation; texts follow from it.
    totals = found.groupBy("host_ip").agg(
        F.sum("alerts").alias("hits_totali"), F.max("severity").alias("severity"),
    ).select("host_ip", "hits_totali", *[c.alias(n) for n, c in verdicts.scan_worst("severity", p).items()])
    seen = code_hits(found)
    listed = frequent_items(seen, "code", p.list_limit, "codici_rilevati")
    found = totals.join(listed, "host_ip", "left").withColumn(
        "codici_rilevati", F.expr("coalesce(codici_rilevati, CAST(array() AS array<int>))"))
    return found.withColumn("codici_descritti", scan_labels("codici_rilevati"))


def port_or_scan_alerts(alerts: DataFrame, p: RiskParams, window: Window_ | None = None) -> DataFrame:
    """Alerts on local hosts that m_srv or m_scan counts, in the window or at any time."""
    alerts = alerts if window is None else in_windows(alerts, "tstamp", window)
    return alerts.filter(
        F.expr(f"alert_id IN ({p.srv_alert_id}, {p.scan_alert_id})") & is_local_text("ip", p)
    ).withColumnRenamed("ip", "host_ip")


def host_alert_groups(p: RiskParams) -> list[Column]:
    """The keys beside the host under which host_alert_measures takes its counts, `alerts`."""
    return [F.col("alert_id"), F.when(F.expr(f"alert_id = {p.srv_alert_id}"), contacted_port("json")).alias("port"),
            F.when(F.expr(f"alert_id = {p.scan_alert_id}"), scan_codes("json")).alias("codes")]


def host_alert_activity(alerts: DataFrame, p: RiskParams) -> DataFrame:
    """The measures of m_srv and m_scan from one scan and one first shuffle."""
    groups = port_or_scan_alerts(alerts, p, host_alert_window(p)).groupBy("host_ip", *host_alert_groups(p)).agg(
        F.count(F.lit(1)).alias("alerts"))
    return host_alert_measures(groups, p)


def host_alert_measures(groups: DataFrame, p: RiskParams) -> DataFrame:
    """The measures of m_srv and m_scan from alerts per host, kind, port and set of codes."""
    is_port, is_scan = f"alert_id = {p.srv_alert_id}", f"alert_id = {p.scan_alert_id}"
    groups = groups.withColumn("severity", F.when(F.expr(is_scan), verdicts.scan_rank("codes")).otherwise(0))
    totals = groups.groupBy("host_ip").agg(
        F.expr(f"coalesce(sum(CASE WHEN {is_port} THEN alerts END), 0) AS srv_hits"),
        F.expr(f"count_if({is_port}) AS porte_distinte"),
        F.expr("coalesce(sum(CASE WHEN severity > 0 THEN alerts END), 0) AS scan_hits"),
        F.max("severity").alias("severity"),
    )
    # Outer, as an inner one would put a filter on the groups and so part their shuffle from that of the totals.
    item = F.expr(f"CASE WHEN {is_port} THEN array(port) WHEN severity > 0 THEN array_distinct(codes) END")
    seen = (
        groups.select("host_ip", "alert_id", "alerts", F.explode_outer(item).alias("item"))
        .groupBy("host_ip", "alert_id", "item").agg(F.sum("alerts").alias("hits")).filter("item IS NOT NULL")
    )
    if p.list_limit is not None:
        order = Window.partitionBy("host_ip", "alert_id").orderBy(F.desc("hits"), "item")
        seen = seen.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= p.list_limit)
    listed = seen.groupBy("host_ip").agg(*[
        F.array_sort(F.collect_list(F.expr(f"CASE WHEN {kind} THEN item END"))).alias(name)
        for kind, name in ((is_port, "lista_porte"), (is_scan, "codici_rilevati"))])
    found = totals.join(listed, "host_ip", "left").withColumn(
        "codici_rilevati", F.expr("coalesce(codici_rilevati, CAST(array() AS array<int>))"))
    return found.select("*", scan_labels("codici_rilevati").alias("codici_descritti"),
                        *[c.alias(n) for n, c in verdicts.scan_worst("severity", p).items()])


def m_scan(inputs: MetricInputs, p: RiskParams, minutes: int | None = None) -> DataFrame:
    p = p.pinned()
    return verdicts.scan(p).flagged(scans(inputs.host_alerts, p, minutes))
