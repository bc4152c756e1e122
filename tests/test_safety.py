"""Nothing is lost or doubled in silence."""

from dataclasses import replace
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import PARAMS, REF, by_host
from wardline import METRICS, MetricInputs, RiskParams, schemas
from wardline.functions import timewin
from wardline.operators import novelty
from wardline.plans import scoring
from wardline.sources import tables as source


def test_two_rows_for_a_host_are_an_error(spark):
    frame = spark.createDataFrame([("10.0.0.1", 30), ("10.0.0.1", 50), ("10.0.0.2", 5)], "host_ip string, penalita int")
    with pytest.raises(Exception, match="more than one row for host 10.0.0.1"):
        scoring.host_scores({"M_own": frame}, PARAMS).collect()


def test_no_metric_gives_an_empty_network(spark):
    scores = scoring.host_scores({}, PARAMS)
    assert scores.collect() == []
    assert scoring.network_index(scores, PARAMS).first()["fascia_globale"] == "VERDE"


def test_one_metric_sees_one_instant(tables, monkeypatch):
    """Under a clock that ticks at each look, the windows of a plan still fit together."""
    clock = iter(range(10 ** 9, 10 ** 9 + 10 ** 6))
    monkeypatch.setattr("wardline.params.time.time", lambda: next(clock))
    seen = []
    for name in ("current_window", "category_windows", "alert_window", "host_alert_window"):
        real = getattr(timewin, name)

        def looked(p, *args, real=real):
            seen.append(p.flows_epoch)
            return real(p, *args)

        for module in ("baseline", "flow_metrics", "flow_alerts", "host_alerts"):
            monkeypatch.setattr(f"wardline.operators.{module}.{name}", looked, raising=False)
    inputs = tables.inputs()
    for spec in METRICS:
        seen.clear()
        spec.fn(inputs, RiskParams())
        assert seen and len(set(seen)) == 1


def test_full_and_short_lists(tables):
    for port in range(1, 15):
        for _ in range(15 - port):
            tables.host_alert("10.0.0.1", 29, f'{{"port":{port}}}')
        tables.alert("10.0.0.1", bits=(5,), port=port, json='{"alerts":{"30":{"proto.ndpi":"IRC"}}}')
        tables.host_alert("10.0.0.1", 15, f'{{"alerts":[{port + 10}]}}')
    inputs = tables.inputs()
    for limit, ports in ((10, list(range(1, 11))), (None, list(range(1, 15))), (2, [1, 2])):
        p = replace(PARAMS, list_limit=limit)
        details = by_host(scoring.fused_host_scores(inputs, p))["10.0.0.1"]["dettagli"]
        assert details["M_srv"]["lista_porte"] == ports and details["M_srv"]["porte_distinte"] == 14
        assert details["M_proto"]["combinazioni_distinte"] == 14
        assert len(details["M_proto"]["lista_mismatch"]) == len(details["M_scan"]["codici_rilevati"]) == len(ports)
        single = {s.key: s.fn(inputs, p) for s in METRICS}
        assert by_host(scoring.host_scores(single, p))["10.0.0.1"]["dettagli"] == details
    items = scoring.host_items(inputs, PARAMS).groupBy("metric").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))
    assert {r["metric"]: (r["n"], r["hits"]) for r in items.collect()} == {
        "M_srv": (14, sum(range(1, 15))), "M_proto": (14, 14), "M_scan": (14, 14)}


def test_types_of_a_foreign_table(spark, tables):
    rows = [(Decimal(1 << 6), True, Decimal(167772161), REF)]
    foreign = spark.createDataFrame(
        rows, "flow_risk decimal(20,0), is_srv_blacklisted boolean, ipv4_src_addr decimal(20,0), first_seen timestamp")
    typed = source.flows_of(foreign.withColumn("note", F.lit("x")))
    assert dict(typed.dtypes) == {"FLOW_RISK": "bigint", "IS_SRV_BLACKLISTED": "int", "IPV4_SRC_ADDR": "bigint",
                                  "FIRST_SEEN": "timestamp", "note": "string"}
    assert typed.select("FLOW_RISK", "IS_SRV_BLACKLISTED").first() == (64, 1)
    with pytest.raises(Exception, match="OVERFLOW|out of range"):
        source.flows_of(spark.createDataFrame([(Decimal(1 << 64),)], "FLOW_RISK decimal(20,0)")).collect()


def test_a_day_written_again_is_not_doubled(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("10.0.0.1", datetime(2024, 3, d, 12), 15, "{}") for d in range(1, 4)]
    frame = spark.createDataFrame(rows, schemas.HOST_ALERTS)
    for _ in range(2):
        source.write_by_day(frame, path, "tstamp")
    source.write_by_day(frame.filter("day(tstamp) = 2"), path, "tstamp")
    assert source.read_host_alerts(spark, path).count() == 3
    source.write_by_day(frame.filter("day(tstamp) = 2"), path, "tstamp", mode="append")
    assert source.read_host_alerts(spark, path).count() == 4


def test_novelty_leaves_out_rows_without_an_item(spark):
    now, before = REF - timedelta(minutes=5), REF - timedelta(days=3)
    rows = [("a", before, 1), ("a", now, None), ("a", now, 2)]
    found = novelty.service_novelty(spark.createDataFrame(rows, "h string, ts timestamp, item int"), PARAMS, "h", "ts", "item")
    assert [tuple(r) for r in found.collect()] == [("a", 2)]


def test_report_can_be_put_in_order_again(tables):
    for host, bits in (("10.0.0.9", (6, 24)), ("10.0.0.2", (6, 24)), ("10.0.0.5", (24,))):
        tables.alert(host, bits=bits)
    rows = scoring.suspect_details(scoring.fused_host_scores(tables.inputs(), PARAMS), PARAMS).collect()
    order = [(-r["score"], r["host_ip"], r["ordine_metrica"], r["posizione"]) for r in rows]
    assert order == sorted(order) and {r["metrica"]: r["ordine_metrica"] for r in rows} == {"M_cert": 1, "M_sni": 2}


def test_inputs_without_a_profile_read_flows(tables):
    inputs = tables.inputs()
    assert inputs.profile is None and isinstance(inputs, MetricInputs)
