import sys
from datetime import datetime, timedelta, timezone
from ipaddress import IPv4Address
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from wardline import MetricInputs, RiskParams, schemas  # noqa: E402

REF = datetime(2024, 3, 4, 14, 30, tzinfo=timezone.utc)  # a Monday, within working hours
PARAMS = RiskParams(flows_ref=REF)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("wardline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def address(text):
    return int(IPv4Address(text))


class Tables:
    """Builds small flow and alert tables row by row."""

    def __init__(self, spark):
        self.spark = spark
        self._flows, self._alerts, self._host_alerts = [], [], []

    def flow(self, src, seen, dst="8.8.8.8", sent=0, answers=5, risk=0, srv_bl=0, cli_bl=0, status=0):
        src = src if isinstance(src, int) else address(src)
        self._flows.append((
            len(self._flows), 4, seen, seen + timedelta(seconds=5), src, address(dst), sent, 1, answers,
            risk, srv_bl, cli_bl, status))

    def alert(self, client, seen=REF - timedelta(minutes=10), bits=(), port=443, json="{}"):
        self._alerts.append((client, seen, sum(1 << b for b in bits), port, json))

    def host_alert(self, host, alert_id, json, seen=REF - timedelta(minutes=10)):
        self._host_alerts.append((host, seen, alert_id, json))

    def inputs(self):
        frame = self.spark.createDataFrame
        return MetricInputs(
            flows=frame(self._flows, schemas.FLOWS),
            host_alerts=frame(self._host_alerts, schemas.HOST_ALERTS),
            alerted_flows=frame(self._alerts, schemas.FLOW_ALERTS),
        )


@pytest.fixture
def tables(spark):
    return Tables(spark)


def by_host(frame):
    return {row["host_ip"]: row.asDict(recursive=True) for row in frame.collect()}
