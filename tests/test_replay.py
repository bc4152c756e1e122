"""The replay of a range equals one run per hour."""

import random
from dataclasses import replace
from datetime import timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from conftest import REF, address
from wardline import MetricInputs, RiskParams, schemas
from wardline.functions.timewin import HOUR
from wardline.operators import replay
from wardline.operators.flow_metrics import m_fail, m_vol

END = REF.replace(minute=0)


@pytest.fixture(scope="module")
def flows(spark):
    draw, rows = random.Random(8), []
    for i in range(5000):
        host = 1 if draw.random() < 0.35 else draw.randrange(2, 6)
        seen = END - timedelta(seconds=draw.randrange(9 * 86400))
        rows.append((i, 4, seen, seen, address(f"10.0.0.{host}"), address(draw.choice(["8.8.8.8", "10.0.0.9"])),
                     draw.randrange(200 << 20), 1, draw.choice([0, 5, 5]), draw.choice([0, 1 << 43, 1 << 51]), 0, 0, 0))
    return spark.createDataFrame(rows, schemas.FLOWS).repartition(4).cache()


def rows_of(frame):
    return sorted(sorted((k, repr(v)) for k, v in r.asDict(recursive=True).items() if k != "timestamp") for r in frame.collect())


@pytest.mark.parametrize("changes", [
    {}, {"current_window_hours": 5}, {"local_tz": "Asia/Kathmandu"}, {"history_days": 2, "weekend_days": ()}])
def test_every_hour_equals_a_run_of_its_own(spark, flows, changes):
    p = replace(RiskParams(flows_ref=END, min_baseline_buckets=2, fail_min_flows=2, vol_min_bytes=0), **changes)
    shift = 900 if "local_tz" in changes else 0  # whole hours there
    start, end = int(END.timestamp()) - 30 * HOUR + shift, int(END.timestamp()) + HOUR + shift
    refs = [*range(start, end, 10 * HOUR)]
    inputs = MetricInputs(flows=flows, host_alerts=spark.createDataFrame([], schemas.HOST_ALERTS))
    for only_fired in (True, False):
        got = replay.hourly_replay(flows, p, start, end, only_fired)
        for key, metric in (("M_vol", m_vol), ("M_fail", m_fail)):
            frame = got[key].filter(F.unix_seconds("ref").isin(refs))
            expected = []
            for ref in refs:
                one = metric(inputs, replace(p, flows_ref=ref), only_fired)
                expected += rows_of(one.withColumn("ref", F.timestamp_seconds(F.lit(ref))))
            assert rows_of(frame) == sorted(expected) and (expected or only_fired)


def test_history_is_sent_to_its_host_once(flows):
    p = RiskParams(flows_ref=END)
    end = int(END.timestamp())
    plan = replay.hourly_replay(flows, p, end - 24 * HOUR, end)["M_vol"]._jdf.queryExecution().executedPlan().toString()
    # one exchange for the roll-up to hours and one to the host; the windows need none of their own
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_only_whole_hours_are_replayed(flows):
    end = int(END.timestamp())
    with pytest.raises(ValueError, match="whole hours"):
        replay.hourly_replay(flows, RiskParams(flows_ref=END), end - HOUR, end + 60)
    assert int(END.astimezone(ZoneInfo("Asia/Kathmandu")).utcoffset().total_seconds()) % HOUR == 2700
