"""Metrics over all flows: reputation, outgoing volume and failure rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.ip import ipv4_to_string
from wardline.functions.timewin import alert_window, in_windows
from wardline.inputs import MetricInputs
from wardline.operators import verdicts
from wardline.operators.baseline import is_subject
from wardline.params import RiskParams
from wardline.plans.profile import activity_of


SRV_LISTED, CLI_LISTED = "IS_SRV_BLACKLISTED = 1", "IS_CLI_BLACKLISTED = 1"


def blacklisted(flows: DataFrame, p: RiskParams) -> DataFrame:
    """Flows of local hosts with a blacklisted side."""
    return flows.filter(is_subject(p) & F.expr(f"{SRV_LISTED} OR {CLI_LISTED}"))


def blacklist_counts() -> list[Column]:
    return [F.count_if(F.expr(SRV_LISTED)).alias("hits_srv"), F.count_if(F.expr(CLI_LISTED)).alias("hits_cli")]


def blacklist_hits(flows: DataFrame, p: RiskParams, minutes: int | None = None) -> DataFrame:
    """Per host: flows to a blacklisted server and flows flagged on the client side."""
    return (
        blacklisted(in_windows(flows, "FIRST_SEEN", alert_window(p, minutes)), p)
        .groupBy("IPV4_SRC_ADDR").agg(*blacklist_counts())
        .withColumn("host_ip", ipv4_to_string("IPV4_SRC_ADDR"))
    )


def m_rep(inputs: MetricInputs, p: RiskParams, minutes: int | None = None) -> DataFrame:
    p = p.pinned()
    return verdicts.reputation(p).flagged(blacklist_hits(inputs.flows, p, minutes))


def m_vol(inputs: MetricInputs, p: RiskParams, only_fired: bool = True) -> DataFrame:
    """Hosts whose outgoing volume is far above their own baseline.

    With only_fired=False every comparable host is kept, M_vol being 0 or 1.
    """
    p = p.pinned()
    hosts, verdict = activity_of(inputs, p, "v"), verdicts.volume(p)
    return verdict.flagged(hosts) if only_fired else verdict.compared(hosts)


def m_fail(inputs: MetricInputs, p: RiskParams, only_fired: bool = True) -> DataFrame:
    """Hosts whose share of failed flows is far above their own baseline."""
    p = p.pinned()
    hosts, verdict = activity_of(inputs, p, "r"), verdicts.failure_rate(p)
    return verdict.flagged(hosts) if only_fired else verdict.compared(hosts)
