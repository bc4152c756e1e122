"""Streamed metrics equal the batch metrics hour by hour, and late rows are counted."""

import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import address
from wardline import MetricInputs, RiskParams, schemas
from wardline.operators.flow_alerts import m_cert, m_proto, m_sni
from wardline.operators.flow_metrics import m_rep
from wardline.operators.host_alerts import m_scan, m_srv
from wardline.streaming import metric_stream as op

START = datetime(2024, 3, 4, 8, tzinfo=timezone.utc)
PARAMS = RiskParams(flows_ref=START, list_limit=2)
METRICS = {
    "M_rep": (op.REPUTATION, m_rep), "M_cert": (op.ALERTED_FLOWS, m_cert), "M_sni": (op.ALERTED_FLOWS, m_sni),
    "M_proto": (op.ALERTED_FLOWS, m_proto), "M_srv": (op.HOST_ALERTS, m_srv), "M_scan": (op.HOST_ALERTS, m_scan)}


def tables_of(hours, seed=2):
    draw, flows, alerts, hosts = random.Random(seed), [], [], []
    for i in range(900):
        seen = START + timedelta(seconds=draw.randrange(hours * 3600))
        ip = draw.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2", "192.168.3.4", "8.8.4.4"])
        flows.append((i, 4, seen, seen, address(ip), address("8.8.8.8"), 5, 1, 5, 0, int(draw.random() < 0.3),
                      int(draw.random() < 0.3), 0))
        alerts.append((draw.choice([ip, "fd00::1"]), seen, sum(1 << b for b in draw.choice([(6,), (29, 5), (24,), (5,), (40,)])),
                       draw.randrange(440, 444), draw.choice(["{}", '{"alerts":{"30":{"proto.ndpi":"TLS"}}}'])))
        hosts.append((ip, seen, draw.choice([15, 29, 3]), draw.choice(
            ['{"alerts":[2,4]}', '{"alerts":[1]}', "{}", '{"port":80}', '{"port":443}'])))
    return flows, alerts, hosts


def comparable(rows):
    return sorted((sorted((k, repr(v)) for k, v in row.asDict(recursive=True).items() if k != "timestamp") for row in rows))


class Arrivals:
    """A folder of files that a stream takes in one by one."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, rows):
        frame = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        frame.write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


SCHEMAS = {"reputation": schemas.FLOWS, "alerted_flows": schemas.FLOW_ALERTS, "host_alerts": schemas.HOST_ALERTS}
AT = {"reputation": 2, "alerted_flows": 1, "host_alerts": 1}


@pytest.mark.parametrize("family", [op.REPUTATION, op.ALERTED_FLOWS, op.HOST_ALERTS], ids=lambda f: f.name)
def test_out_of_order_batches_equal_the_batch_metrics(spark, tmp_path, family):
    hours, draw = 6, random.Random(4)
    flows, alerts, hosts = tables_of(hours)
    frames = [spark.createDataFrame(r, s) for r, s in
              ((flows, schemas.FLOWS), (hosts, schemas.HOST_ALERTS), (alerts, schemas.FLOW_ALERTS))]
    inputs = MetricInputs(*frames)
    rows = {"reputation": flows, "alerted_flows": alerts, "host_alerts": hosts}[family.name]
    at = AT[family.name]
    # Rows come up to fifty minutes late, so each file holds several hours.
    rows = sorted(rows, key=lambda r: r[at] + timedelta(minutes=draw.randrange(50)))
    arrivals = Arrivals(spark, tmp_path / "in", SCHEMAS[family.name])
    path, progress = str(tmp_path / "table"), str(tmp_path / "progress")

    def run():
        op.stream_family(arrivals.stream(), family, path, progress, PARAMS, delay="1 hour").awaitTermination()

    for part in range(3):
        arrivals.add(rows[part * 300:part * 300 + 300])
        run()
    before = {k: comparable(f.collect()) for k, f in op.closed_windows(spark, family, path, PARAMS).items()}
    run()  # nothing new has come: nothing is counted again
    after = {k: comparable(f.collect()) for k, f in op.closed_windows(spark, family, path, PARAMS).items()}
    assert before == after and op.late_rows(spark, path).collect() == []

    counted = family.rows(spark.createDataFrame(rows, SCHEMAS[family.name]), PARAMS)
    watermark = counted.agg(F.max(family.ts)).first()[0].astimezone(timezone.utc) - timedelta(hours=1)
    closed = [START + timedelta(hours=h) for h in range(1, hours + 1) if START + timedelta(hours=h) <= watermark]
    assert len(closed) >= hours - 2
    for key, (of, batch) in METRICS.items():
        if of is not family:
            continue
        expected = []
        for ref in closed:
            p = replace(PARAMS, flows_ref=ref)
            expected += comparable(
                batch(inputs, p).withColumn("ref", F.timestamp_seconds(F.lit(int(ref.timestamp())))).collect())
        assert after[key] == sorted(expected) and len(expected) > 0


def test_rows_after_the_watermark_are_counted_as_late(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path / "in", schemas.HOST_ALERTS)
    path, progress = str(tmp_path / "table"), str(tmp_path / "progress")
    empty = op.late_rows(spark, path)
    assert empty.collect() == [] and op.closed_windows(spark, op.HOST_ALERTS, path, PARAMS) == {}

    def batch(*minutes):
        arrivals.add([("10.0.0.1", START + timedelta(minutes=m), 29, '{"port":%d}' % m) for m in minutes])
        op.stream_family(arrivals.stream(), op.HOST_ALERTS, path, progress, PARAMS).awaitTermination()

    batch(5, 30)
    batch(100, 20)  # the second comes late, but the watermark is still at 20 minutes
    batch(75, 50, 61)  # the first hour is closed: 50 is too late, 61 and 75 are not
    batch(200)
    ports = op.closed_windows(spark, op.HOST_ALERTS, path, PARAMS)["M_srv"].orderBy("ref").collect()
    assert [(r["ref"].astimezone(timezone.utc).hour, r["hits_totali"], r["lista_porte"]) for r in ports] == [
        (9, 3, [5, 20]), (10, 3, [61, 75])]
    late = op.late_rows(spark, path).collect()
    assert [(r["ref"].astimezone(timezone.utc).hour, r["arrived"], r["late"]) for r in late] == [(9, 4, 1)]
    newer = op.closed_windows(spark, op.HOST_ALERTS, path, PARAMS, since=int(START.timestamp()) + 2 * 3600)
    assert newer["M_srv"].count() == 1


def test_another_checkpoint_is_refused_and_streams_add_up(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path / "in", schemas.HOST_ALERTS)
    arrivals.add([("10.0.0.1", START + timedelta(minutes=m), 29, '{"port":1}') for m in (1, 2, 200)])
    path = str(tmp_path / "table")

    def run(progress, **options):
        op.stream_family(arrivals.stream(), op.HOST_ALERTS, path, str(tmp_path / progress), PARAMS, **options).awaitTermination()

    run("one")
    with pytest.raises(ValueError, match="does not know"):
        run("two")
    run("two", stream="second")
    (row,) = op.closed_windows(spark, op.HOST_ALERTS, path, PARAMS)["M_srv"].collect()
    assert row["hits_totali"] == 4 and op.late_rows(spark, path).collect() == []


def test_a_batch_writes_a_few_files_a_day_whatever_the_tasks(spark, tmp_path):
    arrivals, days, hosts = Arrivals(spark, tmp_path / "in", schemas.HOST_ALERTS), 3, 200
    arrivals.add([(f"10.0.0.{h}", START + timedelta(days=d, minutes=h), 29, '{"port":%d}' % h)
                  for d in range(days) for h in range(hosts)] + [("10.0.0.1", START + timedelta(days=days), 29, "{}")])
    path, tasks = tmp_path / "table", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        op.stream_family(arrivals.stream(), op.HOST_ALERTS, str(path), str(tmp_path / "progress"), PARAMS).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    written = [sum(1 for _ in day.rglob("*.parquet")) for day in path.glob("kind=closed/dt=*")]
    assert len(written) == days and max(written) <= op.FILES_A_DAY
    assert all(sum(1 for _ in day.rglob("*.parquet")) == 1 for day in path.glob("kind=arrived/dt=*"))
    ports = op.closed_windows(spark, op.HOST_ALERTS, str(path), PARAMS)["M_srv"]
    assert ports.agg(F.sum("hits_totali")).first()[0] == days * hosts and op.late_rows(spark, str(path)).collect() == []
