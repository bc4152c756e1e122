"""Host risk analytics over network flow and alert tables, on Spark DataFrames."""

from wardline.inputs import MetricInputs
from wardline.params import RiskParams
from wardline.plans.registry import METRICS, MetricSpec, run_metrics
from wardline.plans.run import score_network

__all__ = ["METRICS", "MetricInputs", "MetricSpec", "RiskParams", "run_metrics", "score_network"]
