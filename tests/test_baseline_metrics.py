"""Volume and failure rate: rules, host profiles, seasons and brute-force comparison."""

import statistics
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import PARAMS, REF, Tables, address, by_host
from wardline import RiskParams
from wardline.functions.text import CAUSE_LABELS
from wardline.operators import baseline, verdicts
from wardline.operators.flow_metrics import m_fail, m_vol

MB = 1024 * 1024
KB = 1024

# v_out, median, MAD -> fired, effective MAD, z
VOLUME_CASES = [
    (78 * MB, 12.5 * MB, 2.8 * MB, True, 2.8 * MB, 65.5 / 2.8),
    (14 * MB, 12.5 * MB, 2.8 * MB, False, 2.8 * MB, 1.5 / 2.8),
    (80 * MB, 1 * MB, 0, True, MB, 79.0),
    (100 * MB, 10 * MB, 500 * KB, True, MB, 90.0),
    (100 * MB, 10 * MB, 5 * MB, True, 5 * MB, 18.0),
    (80 * MB, 500 * KB, 50 * KB, True, MB, 80 - 500 / 1024),
    (30 * MB, 5 * MB, 1 * MB, False, MB, 25.0),
    (5 * MB, 200 * MB, 10 * MB, False, 20 * MB, -9.75),
    (60 * MB, 50 * MB, 10 * MB, False, 10 * MB, 1.0),
    (80 * MB, 50 * MB, 10 * MB, False, 10 * MB, 3.0),
    (50 * MB, 5 * MB, 1 * MB, False, MB, 45.0),
    (100 * MB, 0, 0, True, MB, 100.0),
    (3529303432, 21961703, 0, True, 2196170.3, 1597.0263),  # from a captured run
]


def judged(spark, verdict, **measures):
    """One host with the given measures, judged by a rule."""
    row = {"host_ip": "10.0.0.1", "n_totali": 100, "bucket_baseline": 30, "categoria_temporale": "weekend", **measures}
    types = {int: "long", float: "double", str: "string"}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in row.items()))
    compared = verdict.compared(frame).first()
    fired = verdict.flagged(frame).count() == 1
    assert compared is None or compared[verdict.key] == int(fired)
    return fired, compared


@pytest.mark.parametrize("out, median, mad, fires, mad_eff, z", VOLUME_CASES)
def test_volume_rule(spark, out, median, mad, fires, mad_eff, z):
    fired, row = judged(spark, verdicts.volume(PARAMS), v_out=out, v_mediana=float(median), v_mad=float(mad))
    assert fired is fires
    assert row["z_modified"] == pytest.approx(z, rel=1e-3)
    assert row["mad_eff"] == int(mad_eff)
    assert row["penalita"] == (20 if fires else 0)


@pytest.mark.parametrize("flows, failed, median, mad, fires, z", [
    (100, 60, 0.1, 0.1, True, 5.0),  # plain case
    (100, 25, 0.0, 0.01, False, 5.0),  # rate below the minimum
    (100, 40, 0.5, 0.1, False, -1.0),  # better than usual
    (49, 40, 0.0, 0.0, False, None),  # too few flows
    (200, 80, 0.0, 0.0, True, 8.0),  # both zero, the floor counts
    (100, 50, 0.2, 0.1, False, 3.0),  # z exactly at its limit
    (100, 30, 0.0, 0.05, False, 6.0),  # rate exactly at its limit
    (561, 274, 0.26667, 0.0, True, 4.4349),  # from a captured run
])
def test_failure_rule(spark, flows, failed, median, mad, fires, z):
    causes = {f"n_{c}": 0 for c in CAUSE_LABELS}
    fired, row = judged(spark, verdicts.failure_rate(PARAMS), n_totali=flows, n_falliti=failed,
                        r_mediana=median, r_mad=mad, **causes)
    assert fired is fires
    if z is None:
        assert row is None
    else:
        assert row["z_modified"] == pytest.approx(z, rel=1e-3)
        assert row["penalita"] == (30 if fires else 0)


def test_cold_start_is_not_judged(spark):
    fired, row = judged(spark, verdicts.volume(PARAMS), v_out=100 * MB, v_mediana=0.0, v_mad=0.0, bucket_baseline=29)
    assert not fired and row is None


@pytest.mark.parametrize("counts, label, number", [
    ((12, 250, 12, 15, 230, 3), "ERRORE PROTOCOLLO (NXDOMAIN/HTTP 4xx-5xx)", 250),
    ((274, 0, 274, 0, 0, 0), "SERVER MAI HA RISPOSTO (timeout)", 274),
    ((0, 0, 0, 0, 0, 0), "SERVER MAI HA RISPOSTO (timeout)", 0),
    ((0, 0, 0, 7, 7, 1), "TCP ISSUES (connection refused / scan)", 7),
    ((0, 0, 0, 0, 0, 2), "PROBING ATTEMPT (sondaggio silenzioso)", 2),
])
def test_dominant_cause(spark, counts, label, number):
    schema = "b struct<" + ", ".join(f"{c}: long" for c in CAUSE_LABELS) + ">"
    row = spark.createDataFrame([(counts,)], schema).select(verdicts.dominant_cause("b").alias("d")).first()["d"]
    assert (row["causa"], row["conteggio"]) == (label, number)


def working_hours(ref, days=7):
    """Starts of the working hours of the days before ref, two hours clear of it."""
    hour = ref.replace(minute=0, second=0) - timedelta(days=days) + timedelta(hours=1)
    while hour <= ref - timedelta(hours=3):
        if hour.weekday() < 5 and 9 <= hour.hour <= 17:
            yield hour
        hour += timedelta(hours=1)


def test_volume_profiles(tables):
    hours = list(working_hours(REF))
    assert len(hours) >= 30
    for i, hour in enumerate(hours):
        seen = hour + timedelta(minutes=7)
        for host in ("10.0.0.1", "10.0.0.2"):
            tables.flow(host, seen, sent=(8 + i % 5) * MB)
        tables.flow("10.0.0.3", seen, sent=MB)
        if i < 10:
            tables.flow("10.0.0.4", seen, sent=10 * MB)
    now = REF - timedelta(minutes=20)
    for host, sent in (("10.0.0.1", 12), ("10.0.0.2", 200), ("10.0.0.3", 80), ("10.0.0.4", 100)):
        tables.flow(host, now, sent=sent * MB)
    found = by_host(m_vol(tables.inputs(), PARAMS))
    assert set(found) == {"10.0.0.2", "10.0.0.3"}
    assert found["10.0.0.2"]["v_out"] == 200 * MB and found["10.0.0.2"]["z_modified"] > 3
    assert found["10.0.0.2"]["penalita"] == 20
    assert (found["10.0.0.3"]["mad"], found["10.0.0.3"]["mad_eff"], found["10.0.0.3"]["z_modified"]) == (0, MB, 79.0)
    assert found["10.0.0.3"]["categoria_temporale"] == "feriale_lavorativo"
    assert found["10.0.0.3"]["bucket_baseline"] == len(hours)


def flows_of(tables, host, seen, total, failed, *kinds):
    """total flows, `failed` of them failing with the given (answers, bit) kinds in turn."""
    for i in range(total):
        answers, bit = kinds[i % len(kinds)] if i < failed else (5, None)
        tables.flow(host, seen + timedelta(seconds=i), answers=answers, risk=0 if bit is None else 1 << bit)


def test_failure_profiles(tables):
    silent, error, unresolved, tcp = (0, None), (2, 43), (1, 51), (1, 50)
    for i, hour in enumerate(working_hours(REF)):
        for host in ("10.0.0.1", "10.0.0.2"):
            flows_of(tables, host, hour, 140 + i % 21, 2 + i % 3, silent)
        flows_of(tables, "10.0.0.3", hour, 100, 0, silent)
        if i < 10:
            flows_of(tables, "10.0.0.4", hour, 100, 2, silent)
    now = REF - timedelta(minutes=30)
    flows_of(tables, "10.0.0.1", now, 200, 4, silent)
    flows_of(tables, "10.0.0.2", now, 250, 213, unresolved, error)
    flows_of(tables, "10.0.0.3", now, 200, 80, tcp)
    flows_of(tables, "10.0.0.4", now, 200, 180, silent)
    found = by_host(m_fail(tables.inputs(), PARAMS))
    assert set(found) == {"10.0.0.2", "10.0.0.3"}
    dga = found["10.0.0.2"]
    assert (dga["n_totali"], dga["n_falliti"]) == (250, 213) and dga["z_modified"] > 3
    assert dga["breakdown"] == {"dst2src_zero": 0, "error_code": 106, "unidirectional": 0, "tcp_issues": 0,
                                "unresolved": 107, "probing": 0}
    regular = found["10.0.0.3"]
    assert (regular["mad"], regular["mad_eff"]) == (0.0, 0.05)
    assert regular["z_modified"] == pytest.approx(8.0)


@pytest.mark.parametrize("ref, sent, category, judged_at_all, fires", [
    (datetime(2024, 3, 4, 14, 30, tzinfo=timezone.utc), 15 * MB, "feriale_lavorativo", True, False),
    (datetime(2024, 3, 4, 23, 30, tzinfo=timezone.utc), 60 * MB, "feriale_fuoriorario", True, True),
    (datetime(2024, 3, 9, 14, 30, tzinfo=timezone.utc), 30 * MB, "weekend", False, False),
])
def test_seasons(tables, ref, sent, category, judged_at_all, fires):
    hour = ref.replace(minute=0) - timedelta(days=7) + timedelta(hours=1)
    step = 0
    while hour <= ref - timedelta(hours=3):
        if hour.weekday() < 5:
            volume = (14 + step % 3) * MB if 9 <= hour.hour <= 17 else (30 + step % 41) * KB
            tables.flow("10.0.0.5", hour + timedelta(minutes=5), sent=volume)
        hour += timedelta(hours=1)
        step += 1
    tables.flow("10.0.0.5", ref - timedelta(minutes=20), sent=sent)
    p = RiskParams(flows_ref=ref)
    everyone = by_host(m_vol(tables.inputs(), p, only_fired=False))
    assert bool(everyone) is judged_at_all
    assert bool(by_host(m_vol(tables.inputs(), p))) is fires
    if judged_at_all:
        assert everyone["10.0.0.5"]["categoria_temporale"] == category
        assert everyone["10.0.0.5"]["M_vol"] == int(fires)
    if fires:
        assert everyone["10.0.0.5"]["z_modified"] == pytest.approx(60, rel=0.01)


def test_window_edges_and_filters(tables):
    p = RiskParams(flows_ref=REF, min_baseline_buckets=1, vol_min_bytes=0)
    host, day = "10.0.0.1", timedelta(days=1)
    tables.flow(host, REF - timedelta(hours=1), sent=7 * MB)  # current
    tables.flow(host, REF - timedelta(seconds=1), sent=9 * MB)  # current
    tables.flow(host, REF, sent=1000 * MB)  # neither
    tables.flow(host, REF - 7 * day, sent=2 * MB)  # first instant of the history
    tables.flow(host, REF - 7 * day - timedelta(seconds=1), sent=500 * MB)  # before it
    tables.flow(host, REF - timedelta(hours=1, seconds=1), sent=2 * MB)  # last of the history
    tables.flow(host, REF - timedelta(hours=20), sent=300 * MB)  # another category
    tables.flow(host, REF - day * 4, dst="10.0.0.9", sent=400 * MB)  # inside the networks
    tables.flow("8.8.4.4", REF - timedelta(minutes=5), sent=MB)
    tables.flow(0, REF - timedelta(minutes=5), sent=MB)
    rows = by_host(m_vol(tables.inputs(), p, only_fired=False))
    assert set(rows) == {host}
    row = rows[host]
    assert (row["v_out"], row["v_mediana"], row["bucket_baseline"]) == (16 * MB, 2 * MB, 2)


samples = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(0, 60 * MB), st.booleans()),
                   min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(samples)
def test_baseline_equals_brute_force(spark, rows):
    ref = datetime(2024, 3, 8, 20, 0, tzinfo=timezone.utc)
    p = RiskParams(flows_ref=ref, min_baseline_buckets=1, fail_min_flows=1, weekend_days=(), working_hours=(0, 23))
    tables, past, now = Tables(spark), {}, {}
    for host, hour, sent, failing in rows:
        seen = ref - timedelta(minutes=30) if hour == 0 else ref - timedelta(hours=hour + 1, minutes=-10)
        tables.flow(f"10.0.0.{host}", seen, sent=sent, answers=0 if failing else 5)
        target = now.setdefault(host, []) if hour == 0 else past.setdefault(host, {}).setdefault(hour, [])
        target.append((sent, failing))
    got = by_host(m_vol(tables.inputs(), p, only_fired=False))
    rates = by_host(m_fail(tables.inputs(), p, only_fired=False))
    assert set(got) == set(rates) == {f"10.0.0.{h}" for h in now if h in past}
    for host in set(now) & set(past):
        hours = past[host].values()
        volumes = [sum(s for s, _ in flows) for flows in hours]
        shares = [sum(f for _, f in flows) / len(flows) for flows in hours]
        row, rate = got[f"10.0.0.{host}"], rates[f"10.0.0.{host}"]
        median = statistics.median(volumes)
        assert row["v_out"] == sum(s for s, _ in now[host]) and row["bucket_baseline"] == len(volumes)
        assert row["v_mediana"] == int(median)
        assert row["mad"] == int(statistics.median(abs(v - median) for v in volumes))
        assert rate["r_mediana"] == pytest.approx(np.median(shares))
        assert rate["mad"] == pytest.approx(np.median(np.abs(np.array(shares) - np.median(shares))))


def test_contextual_baseline_is_generic(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", None), ("b", 5.0)], "k string, v double")
    rows = {r["k"]: r for r in baseline.contextual_baseline(frame, "k", {"v": F.col("v")}, 2).collect()}
    assert set(rows) == {"a"}
    assert (rows["a"]["bucket_count"], rows["a"]["v_mediana"], rows["a"]["v_mad"]) == (3, 2.0, 1.0)


def test_numeric_addresses_above_two_to_the_31(tables):
    p = RiskParams(flows_ref=REF, min_baseline_buckets=1, vol_min_bytes=0)
    tables.flow("192.168.255.254", REF - timedelta(hours=2), sent=MB)
    tables.flow("192.168.255.254", REF - timedelta(minutes=2), sent=MB)
    assert address("192.168.255.254") > 2 ** 31
    assert set(by_host(m_vol(tables.inputs(), p, only_fired=False))) == {"192.168.255.254"}
