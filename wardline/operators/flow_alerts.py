"""Metrics over alerted flows: certificates, missing SNI, protocol on the wrong port."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.ip import is_local_text
from wardline.functions.payload import detected_protocol
from wardline.functions.risk import has_any_bit
from wardline.functions.timewin import alert_window, in_windows
from wardline.inputs import MetricInputs
from wardline.operators import verdicts
from wardline.operators.lists import frequent_items
from wardline.params import RiskParams


COMBINATION = "concat({0}.proto, ' su porta ', {0}.port)"  # fixed text of a combination


def alerted_subjects(alerts: DataFrame, p: RiskParams, minutes: int | None, *bits: int) -> DataFrame:
    """Alerted flows of local clients in the window with any of the risk bits."""
    return in_windows(alerts, "tstamp", alert_window(p, minutes)).filter(
        has_any_bit("flow_risk_bitmap", *bits) & is_local_text("cli_ip", p)
    ).withColumnRenamed("cli_ip", "host_ip")


def hits(name: str, bit: int) -> Column:
    return F.count_if(has_any_bit("flow_risk_bitmap", bit)).alias(name)


def certificate_hits(p: RiskParams) -> list[Column]:
    kinds = {"hits_self_signed": p.bit_self_signed, "hits_expired": p.bit_expired, "hits_sha1": p.bit_sha1}
    return [hits(name, bit) for name, bit in kinds.items() if bit is not None]


def m_cert(inputs: MetricInputs, p: RiskParams, minutes: int | None = None) -> DataFrame:
    p = p.pinned()
    alerts = alerted_subjects(inputs.flow_alerts, p, minutes, *p.cert_bits)
    return verdicts.certificate(p).flagged(alerts.groupBy("host_ip").agg(*certificate_hits(p)))


def m_sni(inputs: MetricInputs, p: RiskParams, minutes: int | None = None) -> DataFrame:
    p = p.pinned()
    alerts = alerted_subjects(inputs.flow_alerts, p, minutes, p.bit_missing_sni)
    counts = alerts.groupBy("host_ip").agg(hits("hits_missing", p.bit_missing_sni))
    return verdicts.missing_sni(p).flagged(counts)


def combination_hits(alerts: DataFrame, p: RiskParams, minutes: int | None = None) -> DataFrame:
    """Flows on an unusual port per host and (protocol, port)."""
    combination = F.struct(
        detected_protocol("json").alias("proto"), F.col("srv_port").alias("port"))
    return (
        alerted_subjects(alerts, p, minutes, p.bit_nonstandard_port)
        .groupBy("host_ip", combination.alias("combination"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def mismatches(alerts: DataFrame, p: RiskParams, minutes: int | None = None) -> DataFrame:
    """Per host: flows on an unusual port, distinct (protocol, port), the frequent ones as text."""
    pairs = combination_hits(alerts, p, minutes)
    totals = pairs.groupBy("host_ip").agg(
        F.sum("hits").alias("hits_totali"), F.count(F.lit(1)).alias("combinazioni_distinte"))
    listed = frequent_items(pairs, "combination", p.list_limit, "combinations")
    labels = F.expr(f"transform(combinations, c -> {COMBINATION.format('c')})")
    return totals.join(listed, "host_ip").withColumn("lista_mismatch", labels)


def alert_groups(p: RiskParams) -> tuple[Column, list[Column]]:
    """What alert_measures takes: the key beside the host, NULL for flows on their usual port, and the counts."""
    mismatch = has_any_bit("flow_risk_bitmap", p.bit_nonstandard_port)
    combination = F.when(mismatch, F.struct(detected_protocol("json").alias("proto"), F.col("srv_port").alias("port")))
    return combination.alias("combination"), [
        F.count_if(mismatch).alias("hits"), *certificate_hits(p), hits("hits_missing", p.bit_missing_sni)]


def tls_or_port_alerts(alerts: DataFrame, p: RiskParams, window: tuple[int, int] | None = None) -> DataFrame:
    """Alerted flows of local clients that m_cert, m_sni or m_proto counts, in the window or at any time."""
    alerts = alerts if window is None else in_windows(alerts, "tstamp", window)
    return alerts.filter(
        has_any_bit("flow_risk_bitmap", *p.cert_bits, p.bit_missing_sni, p.bit_nonstandard_port)
        & is_local_text("cli_ip", p)).withColumnRenamed("cli_ip", "host_ip")


def alert_measures(groups: DataFrame, p: RiskParams) -> DataFrame:
    """The measures of m_cert, m_sni and m_proto from counts per host and combination."""
    names = [c for c in groups.columns if c.startswith("hits_")]
    totals = groups.groupBy("host_ip").agg(
        F.sum("hits").alias("hits_totali"), F.count("combination").alias("combinazioni_distinte"),
        *[F.sum(c).alias(c) for c in names])
    listed = frequent_items(groups, "combination", p.list_limit, "combinations", *names)
    labels = F.expr(f"transform(combinations, c -> {COMBINATION.format('c')})")
    return totals.join(listed, "host_ip").withColumn("lista_mismatch", labels)


def alert_activity(alerts: DataFrame, p: RiskParams) -> DataFrame:
    """The measures of m_cert, m_sni and m_proto from one scan and one first shuffle."""
    combination, counts = alert_groups(p)
    return alert_measures(
        tls_or_port_alerts(alerts, p, alert_window(p)).groupBy("host_ip", combination).agg(*counts), p)


def m_proto(inputs: MetricInputs, p: RiskParams, minutes: int | None = None) -> DataFrame:
    p = p.pinned()
    return verdicts.protocol_mismatch(p).flagged(mismatches(inputs.flow_alerts, p, minutes))
