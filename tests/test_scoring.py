"""Scores, bands, network record, reports, novelty, isolation and the whole run."""

from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import PARAMS, REF, by_host
from wardline import METRICS, MetricSpec, RiskParams, run_metrics, score_network
from wardline.operators.novelty import service_novelty
from wardline.plans import scoring
from wardline.plans.registry import metric_report

PENALTIES = {"M_cert": 40, "M_sni": 50, "M_proto": 25, "M_vol": 20, "M_fail": 30, "M_srv": 20}


def scored(spark, hosts, p=PARAMS):
    """Scores from host -> {metric: penalty}, through frames as the metrics give them."""
    frames = {}
    for spec in METRICS:
        rows = [(h, 1, m[spec.key]) for h, m in hosts.items() if spec.key in m]
        frames[spec.key] = spark.createDataFrame(rows, f"host_ip string, {spec.key} int, penalita int")
    return scoring.host_scores(frames, p)


@pytest.mark.parametrize("metrics, raw, score, band", [
    ({"M_cert": 40, "M_proto": 25, "M_scan": 40}, 105, 100, "ROSSO"),
    ({"M_cert": 40, "M_scan": 40}, 80, 80, "ROSSO"),
    ({"M_scan": 40}, 40, 40, "GIALLO"),
    ({"M_proto": 25, "M_scan": 40, "M_fail": 30}, 95, 95, "ROSSO"),
    ({"M_scan": 50, "M_vol": 20}, 70, 70, "ROSSO"),
    ({"M_sni": 50, "M_proto": 25, "M_scan": 40}, 115, 100, "ROSSO"),
    ({"M_proto": 25}, 25, 25, "VERDE"),
])
def test_score_arithmetic(spark, metrics, raw, score, band):
    row = scored(spark, {"10.0.0.1": metrics}).first()
    assert (row["penalita_totale"], row["score"], row["fascia"]) == (raw, score, band)
    assert row["metriche_attive"] == [s.key for s in METRICS if s.key in metrics]


def test_bands(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 29, 30, 59, 60, 100)], "s int")
    assert [r[0] for r in rows.select(scoring.risk_band("s", PARAMS)).collect()] == [
        "VERDE", "VERDE", "GIALLO", "GIALLO", "ROSSO", "ROSSO"]


def test_missing_penalty_counts_nothing(spark):
    frames = {"M_a": spark.createDataFrame([("h",)], "host_ip string"),
              "M_b": spark.createDataFrame([("h", None), ("i", 7)], "host_ip string, penalita int")}
    found = by_host(scoring.host_scores(frames, PARAMS))
    assert found["h"]["score"] == 0 and found["h"]["metriche_attive"] == ["M_a", "M_b"]
    assert found["i"]["score"] == 7


def ares(spark):
    """The hosts of a captured run: twelve seen, six green, one yellow, five red."""
    hosts = {f"192.168.10.{n}": {"M_proto": 25} for n in range(50, 56)}
    hosts["172.16.0.1"] = {"M_scan": 40}
    hosts |= {f"192.168.10.{n}": {"M_cert": 40, "M_scan": 40} for n in (5, 8, 9)}
    hosts |= {f"192.168.10.{n}": {"M_cert": 40, "M_proto": 25, "M_scan": 40} for n in (14, 15)}
    return scored(spark, hosts)


def test_network_index_and_state(spark):
    index = scoring.network_index(ares(spark), PARAMS)
    assert index.first().asDict() == {
        "score_max": 100, "fascia_globale": "ROSSO", "host_verde": 6, "host_giallo": 1, "host_rosso": 5,
        "host_totali_visti": 12}
    assert scoring.network_state(index, PARAMS).first()["stato"] == "diffusione sistemica"
    local = scoring.network_state(index, replace(PARAMS, systemic_from=6)).first()
    assert (local["stato"], local["host_critici"]) == ("anomalia localizzata", 5)


def test_empty_network(spark):
    index = scoring.network_index(scored(spark, {}), PARAMS)
    assert index.first().asDict() == {
        "score_max": 0, "fascia_globale": "VERDE", "host_verde": 0, "host_giallo": 0, "host_rosso": 0,
        "host_totali_visti": 0}
    assert scoring.network_state(index, PARAMS).first()["stato"] == "rete sicura"


def test_ranking(spark):
    ranking = [tuple(r)[:4] for r in scoring.suspect_ranking(ares(spark)).collect()]
    assert [r[1] for r in ranking] == [100, 100, 80, 80, 80, 40]
    assert ranking[0] == ("192.168.10.14", 100, "ROSSO", "M_cert, M_proto, M_scan")
    everything = scored(spark, {"10.0.0.1": {**PENALTIES, "M_rep": 5}})
    listed = scoring.suspect_ranking(everything).first()["metriche"]
    assert listed == "M_rep, M_cert, M_sni, M_srv, M_proto,..."[:37] + "..." and len(listed) == 40


def suspicious(tables):
    """One host on which cert, sni, srv, proto, scan and fail fire, and a clean one."""
    host = "192.168.1.195"
    tables.alert(host, bits=(6, 29))
    tables.alert(host, bits=(24,))
    tables.alert(host, bits=(5,), port=6667, json='{"alerts":{"30":{"proto.ndpi":"IRC"}}}')
    tables.host_alert(host, 15, '{"alerts":[2]}')
    tables.host_alert(host, 29, '{"port":22}')
    for i in range(15):
        tables.flow(host, REF - timedelta(hours=3), answers=0 if i < 4 else 5)
    for i in range(561):
        tables.flow(host, REF - timedelta(minutes=30), answers=0 if i < 274 else 5, risk=1 << 46 if i < 274 else 0)
        tables.flow("10.0.0.2", REF - timedelta(minutes=30))
    return tables.inputs(), RiskParams(flows_ref=REF, min_baseline_buckets=1)


def test_details_of_a_suspect(tables):
    inputs, p = suspicious(tables)
    scores = scoring.fused_host_scores(inputs, p)
    rows = scoring.suspect_details(scores, p).collect()
    assert {r["host_ip"] for r in rows} == {"192.168.1.195"}
    assert {r["penalita_grezza"] for r in rows} == {40 + 50 + 20 + 25 + 40 + 30}
    shown = {(r["metrica"], r["campo"]): r["valore"] for r in rows}
    assert shown["M_cert", "hits_totali"] == "2"
    assert shown["M_proto", "lista_mismatch"] == "['IRC su porta 6667']"
    assert shown["M_scan", "codici_rilevati"] == "[2]"
    assert shown["M_scan", "codici_descritti"] == "['SYN Scan']"
    assert shown["M_fail", "r_corrente"] == "0.4884" and shown["M_fail", "r_mediana"] == "0.2667"
    assert shown["M_fail", "z_modified"] == "4.4349"
    assert shown["M_fail", "breakdown.dst2src_zero"] == shown["M_fail", "breakdown.unidirectional"] == "274"
    fail = sorted((r["posizione"], r["campo"]) for r in rows if r["metrica"] == "M_fail")
    assert [name for _, name in fail][:3] == ["n_totali", "n_falliti", "r_corrente"]


def test_fused_scores_equal_the_metrics_one_by_one(tables):
    inputs, p = suspicious(tables)
    one_by_one = scoring.host_scores({s.key: s.fn(inputs, p) for s in METRICS}, p)
    fused = scoring.fused_host_scores(inputs, p)
    assert [f.name for f in fused.schema] == [f.name for f in one_by_one.schema]
    assert by_host(fused) == by_host(one_by_one)


def test_alert_window_longer_than_the_current_one(tables):
    """Reputation hits may lie in the history window; they must count once, and in both."""
    p = RiskParams(flows_ref=REF, min_baseline_buckets=1, vol_min_bytes=0, alert_window_minutes=1440)
    tables.flow("10.0.0.1", REF - timedelta(hours=3), sent=10, srv_bl=1)
    tables.flow("10.0.0.1", REF - timedelta(hours=20), sent=10, srv_bl=1)  # other category
    tables.flow("10.0.0.1", REF - timedelta(minutes=3), sent=900 << 20, dst="10.0.0.9", srv_bl=1)
    tables.flow("10.0.0.1", REF - timedelta(minutes=3), sent=90 << 20)
    tables.host_alert("10.9.9.9", 1, "{}")
    tables.alert("10.9.9.9")
    inputs = tables.inputs()
    fused = by_host(scoring.fused_host_scores(inputs, p))["10.0.0.1"]
    assert fused["metriche_attive"] == ["M_rep", "M_vol"]
    assert fused["dettagli"]["M_rep"]["hits_srv"] == 3
    assert fused["dettagli"]["M_vol"]["v_out"] == 90 << 20
    assert by_host(scoring.host_scores({s.key: s.fn(inputs, p) for s in METRICS}, p))["10.0.0.1"] == fused


def test_one_failing_metric_leaves_the_others(tables):
    inputs, p = suspicious(tables)

    def broken_plan(inputs, p):
        raise RuntimeError("no such table")

    def broken_job(inputs, p):
        return inputs.flows.select(F.lit("10.0.0.1").alias("host_ip"), F.expr("raise_error('boom') AS penalita"))

    specs = [*METRICS[1:], MetricSpec("M_plan", "fails early", broken_plan), MetricSpec("M_job", "fails late", broken_job)]
    frames, status = run_metrics(inputs, p, specs)
    rows = {r["metric"]: r for r in status.collect()}
    assert [k for k, r in rows.items() if not r["ok"]] == ["M_plan", "M_job"]
    assert "no such table" in rows["M_plan"]["error"] and "boom" in rows["M_job"]["error"]
    assert rows["M_scan"]["n_hosts"] == 1 and rows["M_vol"]["n_hosts"] == 0
    scores = by_host(scoring.host_scores(frames, p))
    assert scores["192.168.1.195"]["score"] == 100 and len(scores) == 1


def test_whole_run_and_its_tables(tables, tmp_path, spark):
    inputs, p = suspicious(tables)
    fused, isolated = score_network(inputs, p), score_network(inputs, p, fused=False)
    assert fused.metric_status.schema.names == isolated.metric_status.schema.names
    statuses = [run.metric_status.select("metric", "ok", "n_hosts").collect() for run in (fused, isolated)]
    assert statuses[0] == statuses[1] and len(statuses[0]) == 8
    assert by_host(fused.host_scores) == by_host(isolated.host_scores)
    isolated.write(str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "network_index")).first()["host_rosso"] == 1
    stored = spark.read.parquet(str(tmp_path / "run" / "host_scores"))
    assert by_host(stored) == by_host(fused.host_scores)
    fused.write(str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json" / "suspects")).first()["score"] == 100


def test_run_falls_back_to_isolated_metrics(tables, spark):
    inputs, p = suspicious(tables)
    damaged = replace(inputs, alerted_flows=inputs.alerted_flows.withColumn(
        "srv_port", F.expr("CAST(raise_error('unreadable') AS INT)")))
    with pytest.warns(UserWarning, match="one by one"):
        run = score_network(damaged, p)
    status = {r["metric"]: r["ok"] for r in run.metric_status.collect()}
    assert [k for k, ok in status.items() if not ok] == ["M_proto"]
    assert run.network_index.first()["host_rosso"] == 1


def test_reports_are_ordered_by_severity(tables):
    for host, hits in (("10.0.0.1", 1), ("10.0.0.2", 3), ("10.0.0.3", 2), ("10.0.0.4", 3)):
        for _ in range(hits):
            tables.alert(host, bits=(24,))
    tables.flow("10.0.0.1", REF)
    tables.host_alert("10.0.0.1", 1, "{}")
    spec = next(s for s in METRICS if s.key == "M_sni")
    assert [r["host_ip"] for r in metric_report(spec, tables.inputs(), PARAMS).collect()] == [
        "10.0.0.2", "10.0.0.4", "10.0.0.3", "10.0.0.1"]


def test_service_novelty(spark):
    day = timedelta(days=1)
    rows = [
        ("a", REF - 5 * day, "dns"), ("a", REF - timedelta(minutes=1), "dns"), ("a", REF - timedelta(minutes=1), "irc"),
        ("a", REF - timedelta(hours=2), "tls"), ("a", REF - timedelta(minutes=2), "tls"),
        ("b", REF - timedelta(hours=3), "dns"), ("b", REF - timedelta(minutes=1), "irc"),  # still learning
        ("c", REF - timedelta(minutes=1), "irc"),  # no history
        ("d", REF - 8 * day, "irc"), ("d", REF - 6 * day, "dns"), ("d", REF - timedelta(minutes=1), "irc"),
    ]
    flows = spark.createDataFrame(rows, "host string, seen timestamp, service string")
    novel = service_novelty(flows, PARAMS, "host", "seen", "service")
    assert sorted(map(tuple, novel.collect())) == [("a", "irc"), ("d", "irc")]
