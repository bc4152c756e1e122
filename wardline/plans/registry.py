"""The ordered list of metrics, and a run in which one failing metric leaves the rest."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.inputs import MetricInputs
from wardline.operators import flow_alerts, flow_metrics, host_alerts
from wardline.params import RiskParams
from wardline.plans.lineage import cut_lineage

STATUS_SCHEMA = "metric string, label string, ok boolean, n_hosts long, ms long, error string, trace string"
EMPTY_SCHEMA = "host_ip string, penalita int"


@dataclass(frozen=True)
class MetricSpec:
    """One metric: fn gives one row per flagged host, with host_ip and penalita."""

    key: str
    label: str
    fn: Callable[[MetricInputs, RiskParams], DataFrame]
    severity: tuple[str, ...] = ("penalita",)  # report order, highest first

    def report_order(self) -> list[Column]:
        return [*[F.desc(c) for c in self.severity], F.asc("host_ip")]


# Keys and labels of the metrics, in scoring order.
METRICS: tuple[MetricSpec, ...] = (
    MetricSpec("M_rep", "Destination reputation", flow_metrics.m_rep, ("penalita", "hits_totali")),
    MetricSpec("M_cert", "TLS certificate anomalies", flow_alerts.m_cert, ("hits_totali",)),
    MetricSpec("M_sni", "SNI evasion", flow_alerts.m_sni, ("hits_missing",)),
    MetricSpec("M_srv", "Server port detected", host_alerts.m_srv, ("hits_totali",)),
    MetricSpec("M_proto", "Non-standard port/protocol", flow_alerts.m_proto, ("hits_totali",)),
    MetricSpec("M_scan", "Network discovery", host_alerts.m_scan, ("penalita", "hits_totali")),
    MetricSpec("M_vol", "Asimmetria volumetrica", flow_metrics.m_vol, ("z_modified",)),
    MetricSpec("M_fail", "Connection failure rate", flow_metrics.m_fail, ("z_modified",)),
)


def metric_report(spec: MetricSpec, inputs: MetricInputs, p: RiskParams) -> DataFrame:
    """The flagged hosts of one metric, most severe first."""
    return spec.fn(inputs, p.pinned()).orderBy(*spec.report_order())


def run_metrics(inputs: MetricInputs, p: RiskParams, specs: Sequence[MetricSpec] = METRICS
                ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Materialise every metric; a failing one becomes an empty frame.

    Plans are lazy, so failures only show when a metric is computed: each metric
    is checkpointed on its own. The metrics are independent jobs and run
    side by side. Returns the frames by key and a status table.
    """
    spark = inputs.flows.sparkSession
    p = p.pinned()
    run_one = inheritable_thread_target(spark)(lambda spec: _run_metric(spark, spec, inputs, p))
    with ThreadPoolExecutor(max_workers=max(1, len(specs))) as pool:
        outcomes = list(pool.map(run_one, specs))
    frames = {spec.key: frame for spec, (frame, _) in zip(specs, outcomes)}
    status = spark.createDataFrame([row for _, row in outcomes], STATUS_SCHEMA)
    return frames, status


def _run_metric(spark: SparkSession, spec: MetricSpec, inputs: MetricInputs, p: RiskParams):
    started = time.perf_counter()

    def row(ok: bool, hosts: int, error: str | None = None, trace: str | None = None):
        return spec.key, spec.label, ok, hosts, round((time.perf_counter() - started) * 1000), error, trace

    schema = EMPTY_SCHEMA
    try:
        frame = spec.fn(inputs, p)
        schema = frame.schema
        frame = cut_lineage(frame)
        return frame, row(True, frame.count())
    except Exception as error:  # noqa: BLE001 - any metric failure must leave the others running
        return spark.createDataFrame([], schema), row(
            False, 0, f"{type(error).__name__}: {error}", traceback.format_exc())
