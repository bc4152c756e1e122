"""A whole scoring run, and its results as tables."""

from __future__ import annotations

import warnings
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from wardline.inputs import MetricInputs
from wardline.params import RiskParams
from wardline.plans.commits import commit
from wardline.plans.lineage import cut_lineage
from wardline.plans.profile import require_history
from wardline.plans.registry import METRICS, run_metrics
from wardline.plans.scoring import (
    flagged_hosts, fused_host_scores, host_items, host_scores, network_index, network_state, suspect_details, suspect_ranking,
)
from wardline.sources.tables import write_result


@dataclass(frozen=True)
class ScoringRun:
    host_scores: DataFrame
    network_index: DataFrame
    network_state: DataFrame
    suspects: DataFrame
    suspect_details: DataFrame
    host_items: DataFrame
    metric_status: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))

    def write(self, path: str, fmt: str = "parquet") -> None:
        for name, frame in self.tables().items():
            write_result(frame, f"{path}/{name}", fmt)

    def commit(self, path: str, fmt: str = "parquet") -> str:
        """All tables as one version that readers see as a whole; see wardline.plans.commits."""
        return commit(self.tables(), path, fmt)


def score_network(inputs: MetricInputs, p: RiskParams, profile: DataFrame | None = None,
                  fused: bool = True, specs=METRICS) -> ScoringRun:
    """Score the network once.

    The fused plan is tried first. If it fails, with fused=False, and for metrics other
    than the usual ones, every metric runs on its own and a failing one is left out;
    metric_status tells which. A profile, here or in the inputs, serves either way.
    The scores are computed once and all reports read that result. In a fused run the
    metrics share their time, so each status has that of the whole run.
    """
    p = p.pinned()
    specs = tuple(specs)
    if profile is not None:
        inputs = replace(inputs, profile=profile)
    if inputs.profile is not None:
        inputs = replace(inputs, profile_gaps=require_history(inputs.profile, inputs.flows, p, inputs.flows_cover))
    status = None
    scores = None
    if fused and specs == METRICS:
        try:
            started = time.perf_counter()
            scores = cut_lineage(fused_host_scores(inputs, p))
            ms = round((time.perf_counter() - started) * 1000)
            labels = " ".join(f"WHEN '{s.key}' THEN '{s.label}'" for s in specs)
            status = flagged_hosts(scores).selectExpr(
                "metric", f"CASE metric {labels} END AS label", "true AS ok", "n_hosts", f"{ms}L AS ms",
                "CAST(NULL AS STRING) AS error", "CAST(NULL AS STRING) AS trace")
        except Exception as error:  # noqa: BLE001 - the isolated run below shows which metric failed
            warnings.warn(f"the fused plan failed, running the metrics one by one: {error}", stacklevel=2)
    if scores is None:
        frames, status = run_metrics(inputs, p, specs)
        scores = cut_lineage(host_scores(frames, p))
    index = network_index(scores, p)
    return ScoringRun(
        host_scores=scores,
        network_index=index,
        network_state=network_state(index, p),
        suspects=suspect_ranking(scores, p),
        suspect_details=suspect_details(scores, p),
        host_items=host_items(inputs, p, [row["metric"] for row in status.filter("ok").collect()]),  # a row per metric
        metric_status=status,
    )
