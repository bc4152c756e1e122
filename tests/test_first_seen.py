"""Novelty from stored sightings equals novelty from raw flows."""

import random
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wardline import RiskParams
from wardline.functions.timewin import DAY, HOUR, current_window, history_window, in_windows
from wardline.operators.novelty import service_novelty
from wardline.plans import first_seen as op

REF = datetime(2024, 3, 20, 14, 30, tzinfo=timezone.utc)
COLUMNS = ("host", "ts", "port")


def params(**changes):
    return replace(RiskParams(flows_ref=REF), **changes)


@pytest.fixture(scope="module")
def flows(spark):
    draw, end, rows = random.Random(3), int(REF.timestamp()), []
    for _ in range(1500):
        at = end - draw.randrange(9 * DAY) if draw.random() < 0.8 else end - draw.randrange(2 * HOUR)
        host = 1 if draw.random() < 0.3 else draw.randrange(2, 25)
        rows.append((host, at, draw.choice([None, *range(1, 40)])))
    rows += [(99, end - 600, 5), (98, end - 25 * HOUR - 1, 4), (98, end - 60, 5), (97, end - 24 * HOUR, 4), (97, end - 60, 5)]
    return spark.createDataFrame(rows, "host long, at long, port int").select("host", F.timestamp_seconds("at").alias("ts"), "port")


def found(frame):
    return sorted(map(tuple, frame.collect()))


def store(flows, path, cuts):
    for window in zip(cuts, cuts[1:]):
        op.add_sightings(flows, path, window, *COLUMNS)


@pytest.mark.parametrize("changes, size", [
    ({}, 2 * DAY), ({"novelty_learning_hours": 3, "current_window_hours": 7}, DAY), ({"history_days": 2}, 11 * HOUR)])
def test_equals_the_raw_form(flows, tmp_path, changes, size):
    p, path = params(**changes), str(tmp_path / "seen")
    start, end = history_window(p)
    # neither edge of the history is one of a delta
    store(flows, path, range(start - 2 * HOUR, end + 2 * size, size))
    expected = found(service_novelty(flows, p, *COLUMNS))
    assert found(op.novelty_from_sightings(flows, path, p, *COLUMNS)) == expected and expected
    store(flows, path, [start - 2 * HOUR, start + 20 * HOUR])  # overlaps what is there
    assert found(op.novelty_from_sightings(flows, path, p, *COLUMNS)) == expected


def test_compaction_keeps_the_result_and_says_when_it_went_too_far(flows, spark, tmp_path):
    p, path = params(), str(tmp_path / "seen")
    start, end = history_window(p)
    cuts = range(start - DAY, end + DAY, DAY)
    store(flows, path, cuts)
    expected = found(service_novelty(flows, p, *COLUMNS))
    op.compact(spark, path, cuts[4], forget_before=start - HOUR)
    assert len(op._covers(spark, path)) == len(cuts) - 4
    assert spark.read.parquet(f"{path}/pairs").filter(F.col("last_seen") < F.timestamp_seconds(F.lit(start - HOUR))).isEmpty()
    assert found(op.novelty_from_sightings(flows, path, p, *COLUMNS)) == expected
    op.compact(spark, path, cuts[4])  # nothing to merge
    op.compact(spark, path, end)
    with pytest.raises(ValueError, match="too far"):
        op.novelty_from_sightings(flows, path, p, *COLUMNS)


def test_a_gap_is_refused(flows, spark, tmp_path):
    p, path = params(), str(tmp_path / "seen")
    start, end = history_window(p)
    with pytest.raises(ValueError, match="does not cover"):
        op.novelty_from_sightings(flows, path, p, *COLUMNS)
    store(flows, path, [start, start + DAY])
    store(flows, path, [start + DAY + 1, end])
    with pytest.raises(ValueError, match="does not cover"):
        op.novelty_from_sightings(flows, path, p, *COLUMNS)
    with pytest.raises(ValueError, match="gaps"):
        op.compact(spark, path, end)
    store(flows.filter("false"), path, [start + DAY, start + DAY + 1])  # a window without flows is covered too
    assert found(op.novelty_from_sightings(flows, path, p, *COLUMNS))


def test_only_the_current_window_of_flows_is_read(flows, spark, tmp_path):
    p, path, table = params(), str(tmp_path / "seen"), str(tmp_path / "flows")
    flows.write.parquet(table)
    stored = spark.read.parquet(table)
    start, end = history_window(p)
    store(stored, path, [*range(start, end, 3 * DAY), end])
    frame = op.novelty_from_sightings(stored, path, p, *COLUMNS)
    scans = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    of_flows = [line for line in scans if table in line]
    now = current_window(p)[0]
    assert of_flows and all(f"GreaterThanOrEqual(ts,{datetime.fromtimestamp(now, timezone.utc):%Y-%m-%d}" in line for line in of_flows)
    assert all("PartitionFilters: [isnotnull(until" in line for line in scans if path in line)
    recent = in_windows(stored, "ts", current_window(p))
    assert found(op.novelty_from_sightings(recent, path, p, *COLUMNS)) == found(frame)


def test_storing_a_window_reads_its_flows_once(flows, spark, tmp_path):
    read, path = spark.sparkContext.accumulator(0), str(tmp_path / "seen")
    end = int(REF.timestamp())
    window = (end - 2 * DAY, end)
    rows = in_windows(flows, "ts", window).collect()

    def noted(row):
        read.add(1)
        return row

    counted = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(noted), flows.schema)
    for _ in range(2):  # the second replaces the first
        op.add_sightings(counted, path, window, *COLUMNS)
    assert read.value == 2 * len(rows)
    seen = [r for r in rows if r["port"] is not None]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/hosts").select("host", "first_seen", "last_seen").collect()) == sorted(
        (h, min(r["ts"] for r in seen if r["host"] == h), max(r["ts"] for r in seen if r["host"] == h))
        for h in {r["host"] for r in seen})


def test_filter_loses_no_key_and_is_bounded(spark):
    keys = spark.range(5000).selectExpr("id AS host", "CAST(id % 7 AS INT) AS item")
    words = op.bloom_words(keys, "host", "item", bits=1 << 12)
    assert words.count() <= (1 << 12) // 64
    assert op.might_contain(keys, words, "host", "item", bits=1 << 12).count() == 5000
    words = op.bloom_words(keys, "host", "item")
    others = spark.range(10_000, 20_000).selectExpr("id AS host", "1 AS item")
    assert op.might_contain(others, words, "host", "item").count() < 100
    assert op.might_contain(others, op.bloom_words(keys.filter("false"), "host", "item"), "host", "item").count() == 0
