"""Items from stored hours equal those read from the alerts, for any window."""

from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import PARAMS, REF
from wardline.functions.timewin import HOUR
from wardline.plans import item_hours as op
from wardline.plans.scoring import host_items

END = int(REF.timestamp())


@pytest.fixture
def inputs(tables):
    for i in range(300):
        seen = REF - timedelta(minutes=7 * i + 1)
        host = f"10.0.0.{i % 3 + 1}"
        tables.alert(host, seen, bits=(5,), port=[0, 1, 80, 32768, 32769, 65535, 443][i % 7],
                     json=['{"alerts":{"30":{"proto.ndpi":"TLS"}}}', "{}"][i % 2])
        tables.host_alert(host, 29, '{"port":%d}' % (i * 997 % 65536), seen)
        tables.host_alert(host, 15, ['{"alerts":[2,3,3]}', '{"alerts":[1,4]}', '{"alerts":[-5,70000,0]}', "{}"][i % 4], seen)
    return tables.inputs()


def expected(inputs, window):
    p = replace(PARAMS, flows_ref=window[1], alerts_ref=window[1], alert_window_minutes=(window[1] - window[0]) // 60)
    return host_items(inputs, p).filter("item IS NOT NULL")


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("window", [
    (END - 20 * HOUR, END), (END - 9 * HOUR - 120, END - HOUR), (END - 600, END - 60), (END - 30 * HOUR - 1800, END - 1800)])
def test_any_window(spark, tmp_path, inputs, window):
    path = str(tmp_path / "items")
    start = END - 30 * HOUR - 1800
    for stored in ((start, start + 11 * HOUR), (start + 14 * HOUR, start + 30 * HOUR)):  # three hours are not stored
        op.write_item_hours(inputs, path, PARAMS, stored)
    op.write_item_hours(inputs, path, PARAMS, (start + 15 * HOUR, start + 17 * HOUR))  # again
    found = op.items_of_window(spark, path, inputs, PARAMS, window)
    want = expected(inputs, window)
    assert rows(op.listed_items(found)) == rows(want.select("host_ip", "metric", "item"))
    counts = want.groupBy("host_ip", "metric").agg(F.count("item").alias("n"), F.sum("hits").alias("hits"))
    assert rows(op.distinct_items(found)) == rows(counts)


def test_stored_hours_alone_serve_whole_hours(spark, tmp_path, inputs):
    path, hours = str(tmp_path / "items"), (END - 1800 - 12 * HOUR, END - 1800)
    op.write_item_hours(inputs, path, PARAMS, hours)
    bare = replace(inputs, host_alerts=inputs.host_alerts.filter("false"), alerted_flows=inputs.alerted_flows.filter("false"))
    assert rows(op.listed_items(op.items_of_window(spark, path, bare, PARAMS, hours))) == rows(
        expected(inputs, hours).select("host_ip", "metric", "item"))
    with pytest.raises(ValueError, match="whole hours"):
        op.write_item_hours(inputs, path, PARAMS, (END - 100, END))


def test_nothing_stored_and_nothing_there(spark, tmp_path, inputs):
    found = op.items_of_window(spark, str(tmp_path / "none"), inputs, PARAMS, (END - 3 * HOUR, END))
    assert rows(op.listed_items(found)) == rows(expected(inputs, (END - 3 * HOUR, END)).select("host_ip", "metric", "item"))
    later = op.items_of_window(spark, str(tmp_path / "none"), inputs, PARAMS, (END + HOUR, END + 2 * HOUR))
    assert later.collect() == [] and op.distinct_items(later).collect() == []
