"""Reputation, certificates, SNI, ports, protocols and scans on small tables."""

from datetime import timedelta

import pytest

from conftest import PARAMS, REF, by_host
from wardline import RiskParams
from wardline.operators.flow_alerts import m_cert, m_proto, m_sni
from wardline.operators.flow_metrics import m_rep
from wardline.operators.host_alerts import m_scan, m_srv

RECENT = REF - timedelta(minutes=10)


def test_reputation_tiers(tables):
    plan = {"10.0.0.1": (1, 0, 30), "10.0.0.2": (2, 0, 30), "10.0.0.3": (3, 0, 50), "10.0.0.4": (0, 1, 5),
            "10.0.0.5": (0, 10, 5), "10.0.0.6": (0, 11, 15), "10.0.0.7": (1, 20, 30)}
    for host, (srv, cli, _) in plan.items():
        for _ in range(srv):
            tables.flow(host, RECENT, srv_bl=1)
        for _ in range(cli):
            tables.flow(host, RECENT, cli_bl=1)
    tables.flow("10.0.0.8", RECENT)  # clean
    tables.flow("8.8.4.4", RECENT, srv_bl=1)  # not ours
    tables.flow(0, RECENT, srv_bl=1)  # pure IPv6
    found = by_host(m_rep(tables.inputs(), PARAMS))
    assert {h: r["penalita"] for h, r in found.items()} == {h: p for h, (_, _, p) in plan.items()}
    assert found["10.0.0.7"]["hits_totali"] == 21
    assert found["10.0.0.3"]["scenario"].startswith("COMPROMISSIONE PERSISTENTE")
    assert found["10.0.0.6"]["scenario"].startswith("SCANSIONE MIRATA")


def test_one_flow_with_both_flags_counts_twice(tables):
    tables.flow("10.0.0.1", RECENT, dst="10.0.0.9", srv_bl=1, cli_bl=1)
    assert by_host(m_rep(tables.inputs(), PARAMS))["10.0.0.1"]["hits_totali"] == 2


def test_window_is_half_open_and_adjustable(tables):
    for host, seen in (("10.0.0.1", REF - timedelta(hours=1)), ("10.0.0.2", REF),
                       ("10.0.0.3", REF - timedelta(hours=1, seconds=1)), ("10.0.0.4", REF - timedelta(seconds=1))):
        tables.flow(host, seen, srv_bl=1)
        tables.alert(host, seen, bits=(24,))
    inputs = tables.inputs()
    for metric in (m_rep, m_sni):
        assert set(by_host(metric(inputs, PARAMS))) == {"10.0.0.1", "10.0.0.4"}
        assert set(by_host(metric(inputs, PARAMS, 5))) == {"10.0.0.4"}
        assert set(by_host(metric(inputs, PARAMS, 61))) == {"10.0.0.1", "10.0.0.3", "10.0.0.4"}


def test_certificates(tables):
    for host, bits in (("10.0.0.1", (6,)), ("10.0.0.2", (29,)), ("10.0.0.3", (6, 29)), ("10.0.0.4", (9,)),
                       ("8.8.8.8", (6,)), ("fd00::1", (6,))):
        tables.alert(host, bits=bits)
    inputs = tables.inputs()
    found = by_host(m_cert(inputs, PARAMS))
    assert {h: r["hits_totali"] for h, r in found.items()} == {"10.0.0.1": 1, "10.0.0.2": 1, "10.0.0.3": 2}
    assert all(r["penalita"] == 40 for r in found.values())
    with_expired = by_host(m_cert(inputs, RiskParams(flows_ref=REF, bit_expired=9)))
    assert with_expired["10.0.0.4"]["hits_expired"] == 1


def test_missing_sni(tables):
    tables.alert("10.0.0.1", bits=(24,))
    tables.alert("10.0.0.1", bits=(24, 5))
    tables.alert("10.0.0.2", bits=(23,))
    found = by_host(m_sni(tables.inputs(), PARAMS))
    assert {h: (r["hits_missing"], r["penalita"]) for h, r in found.items()} == {"10.0.0.1": (2, 50)}


def test_lists_hold_ten_of_twelve(tables):
    for n in range(12):
        tables.host_alert("10.0.0.1", 29, f'{{"port":{8000 + n}}}')
        tables.alert("10.0.0.1", bits=(5,), port=9000 + n, json='{"alerts":{"30":{"proto.ndpi":"SSH"}}}')
    for _ in range(3):  # the most frequent ones are kept
        tables.host_alert("10.0.0.1", 29, '{"port":8011}')
        tables.alert("10.0.0.1", bits=(5,), port=9011, json='{"alerts":{"30":{"proto.ndpi":"SSH"}}}')
    tables.host_alert("10.0.0.2", 29, "broken")
    tables.alert("10.0.0.2", bits=(5,), port=22)
    inputs = tables.inputs()
    ports = by_host(m_srv(inputs, PARAMS))
    assert ports["10.0.0.1"]["lista_porte"] == [*range(8000, 8009), 8011]
    assert (ports["10.0.0.1"]["porte_distinte"], ports["10.0.0.1"]["hits_totali"]) == (12, 15)
    assert ports["10.0.0.2"]["lista_porte"] == [0]
    found = by_host(m_proto(inputs, PARAMS))
    assert found["10.0.0.1"]["lista_mismatch"] == [f"SSH su porta {n}" for n in (*range(9000, 9009), 9011)]
    assert (found["10.0.0.1"]["combinazioni_distinte"], found["10.0.0.1"]["hits_totali"]) == (12, 15)
    assert found["10.0.0.2"]["lista_mismatch"] == [" su porta 22"]
    assert {r["penalita"] for r in ports.values()} == {20} and {r["penalita"] for r in found.values()} == {25}


@pytest.mark.parametrize("codes, penalty", [
    ("[2]", 40), ("[0,3]", 50), ("[4]", 50), ("[0]", 30), ("[]", 30), ("[7]", 30), ("[1,3]", None), ("[1]", None)])
def test_scan_rules(tables, codes, penalty):
    tables.host_alert("192.168.1.5", 15, f'{{"alerts":{codes}}}')
    tables.host_alert("192.168.1.5", 14, '{"alerts":[4]}')  # another kind of alert
    found = by_host(m_scan(tables.inputs(), PARAMS))
    assert (found["192.168.1.5"]["penalita"] if penalty else found) == (penalty or {})


def test_scan_host_is_judged_on_attacks_only(tables):
    for codes in ("[1]", "[2]"):
        tables.host_alert("10.0.0.1", 15, f'{{"alerts":{codes}}}')
    for codes in ("[0,2]", "[2,2]", "[3]", "[7]"):
        tables.host_alert("10.0.0.2", 15, f'{{"alerts":{codes}}}')
    found = by_host(m_scan(tables.inputs(), PARAMS))
    assert (found["10.0.0.1"]["penalita"], found["10.0.0.1"]["hits_totali"]) == (40, 1)
    assert found["10.0.0.2"]["codici_rilevati"] == [0, 2, 3, 7]
    assert found["10.0.0.2"]["codici_descritti"][-1] == "Codice sconosciuto (7)"
    assert found["10.0.0.2"]["categoria_dominante"] == "EVASIONE FIREWALL (FIN/RST scan)"


def test_scan_list_keeps_the_ten_most_frequent_codes(tables):
    for code in range(100, 112):
        tables.host_alert("10.0.0.1", 15, f'{{"alerts":[{code}]}}')
    tables.host_alert("10.0.0.1", 15, '{"alerts":[111,0]}')
    found = by_host(m_scan(tables.inputs(), PARAMS))["10.0.0.1"]
    assert found["codici_rilevati"] == [0, *range(100, 108), 111] and found["hits_totali"] == 13


def test_host_alert_window_is_open_at_now_and_closed_in_replays(tables):
    tables.host_alert("10.0.0.1", 29, '{"port":1}', REF + timedelta(minutes=1))
    tables.host_alert("10.0.0.2", 29, '{"port":1}', REF - timedelta(minutes=1))
    inputs = tables.inputs()
    assert set(by_host(m_srv(inputs, PARAMS))) == {"10.0.0.2"}
    open_ended = RiskParams(flows_ref=REF, open_alerts=True)
    assert set(by_host(m_srv(inputs, open_ended))) == {"10.0.0.1", "10.0.0.2"}
    later = RiskParams(flows_ref=REF, alerts_ref=REF + timedelta(minutes=30))
    assert set(by_host(m_srv(inputs, later))) == {"10.0.0.1", "10.0.0.2"}


def test_alerted_flow_view(spark):
    from pyspark.sql import functions as F

    from wardline import schemas
    from wardline.sources.tables import flow_alerts_view

    flows = spark.createDataFrame(
        [(1, 4, REF, REF, 1, 1, 0, 0, 0, 32, 0, 0, s) for s in (0, 1, 2)], schemas.FLOWS
    ).select("*", F.lit("10.0.0.1").alias("CLI_IP"), F.lit(22).alias("SRV_PORT"), F.lit("{}").alias("JSON"))
    view = flow_alerts_view(flows)
    assert view.columns == schemas.FLOW_ALERTS.names and view.count() == 2
