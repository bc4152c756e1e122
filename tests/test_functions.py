import random
from datetime import datetime
from ipaddress import ip_address, ip_network

import pytest
from pyspark.sql import functions as F

from conftest import PARAMS, address
from wardline import RiskParams
from wardline.functions import ip, payload, risk, text, timewin


def column(spark, values, type_name, expression):
    rows = spark.createDataFrame([(v,) for v in values], f"x {type_name}")
    return [r[0] for r in rows.select(expression).collect()]


EDGES = ["172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "10.0.0.0", "9.255.255.255",
         "192.168.0.1", "192.169.0.0", "147.32.1.1", "147.33.0.0", "0.0.0.0", "255.255.255.255"]


def addresses():
    rng = random.Random(7)
    near = [str(ip_address(int(ip_network(n).network_address) + d) if int(ip_network(n).network_address) + d >= 0
                else ip_address(0)) for n in PARAMS.local_networks for d in (-1, 0, 1, 65535, 65536)]
    return EDGES + near + [str(ip_address(rng.getrandbits(32))) for _ in range(300)]


@pytest.mark.parametrize("networks", [
    PARAMS.local_networks, ("10.1.2.0/24",), ("10.1.2.3/32", "172.16.0.0/13"), ("0.0.0.0/1",), ("0.0.0.0/0",),
    ("10.0.0.0/9", "10.128.0.0/9"), ("203.0.113.64/26",),
])
def test_network_membership(spark, networks):
    values = addresses() + ["10.1.2.3", "203.0.113.64", "203.0.113.128"]
    expected = [any(ip_address(v) in ip_network(n) for n in networks) for v in values]
    assert column(spark, values, "string", ip.text_in_networks("x", networks)) == expected
    numbers = [address(v) for v in values]
    assert column(spark, numbers, "long", ip.in_networks("x", networks)) == expected


def test_text_that_is_no_ipv4_is_never_local(spark):
    values = ["fd00::1", "::ffff:10.0.0.1", "10.0.0", "10.0.0.1x", "10.0.0.256", "172.a.0.1", ""]
    assert column(spark, values, "string", ip.is_local_text("x", PARAMS)) == [False] * len(values)
    assert column(spark, values, "string", ip.ipv4_to_long("x")) == [None] * len(values)


def test_addresses_convert_both_ways(spark):
    values = addresses()
    numbers = [address(v) for v in values]
    assert column(spark, values, "string", ip.ipv4_to_long("x")) == numbers
    assert column(spark, numbers, "long", ip.ipv4_to_string("x")) == values


def test_external_destinations(spark):
    values = ["127.0.0.1", "169.254.1.1", "147.32.1.1", "10.1.1.1", "224.0.0.1", "8.8.8.8"]
    numbers = [address(v) for v in values]
    assert column(spark, numbers, "long", ip.is_external("x", PARAMS)) == [False] * 4 + [True] * 2


@pytest.mark.parametrize("moment, category", [
    (datetime(2024, 3, 4, 8, 59, 59), "feriale_fuoriorario"),
    (datetime(2024, 3, 4, 9, 0), "feriale_lavorativo"),
    (datetime(2024, 3, 8, 17, 59, 59), "feriale_lavorativo"),
    (datetime(2024, 3, 8, 18, 0), "feriale_fuoriorario"),
    (datetime(2024, 3, 9, 12, 0), "weekend"),
    (datetime(2024, 3, 10, 23, 59), "weekend"),
    (datetime(2024, 3, 11, 0, 0), "feriale_fuoriorario"),
])
def test_time_category(spark, moment, category):
    text_value = moment.isoformat(sep=" ")
    assert column(spark, [text_value], "string", timewin.time_category("to_timestamp(x)", PARAMS)) == [category]


def test_local_zone_moves_categories_and_buckets(spark):
    kathmandu = RiskParams(local_tz="Asia/Kathmandu")  # UTC+05:45
    values = ["2024-03-04 03:14:59", "2024-03-04 03:15:00"]  # 08:59:59 and 09:00 there
    assert column(spark, values, "string", timewin.time_category("to_timestamp(x)", kathmandu)) == [
        "feriale_fuoriorario", "feriale_lavorativo"]
    buckets = column(spark, values, "string", timewin.hour_bucket("to_timestamp(x)", kathmandu).cast("string"))
    assert buckets == ["2024-03-04 02:15:00", "2024-03-04 03:15:00"]


def test_bit_tests(spark):
    values = [0, 1 << 5, 1 << 55, (1 << 6) | (1 << 29)]
    assert column(spark, values, "long", risk.has_any_bit("x", 5)) == [False, True, False, False]
    assert column(spark, values, "long", risk.has_any_bit("x", 55, 29)) == [False, False, True, True]


def test_payload_defaults(spark):
    scans = ['{"alerts":[2]}', '{"alerts":[0,3]}', '{"alerts":[]}', "{}", "not json", None, '{"alerts":[1,"x"]}']
    assert column(spark, scans, "string", payload.scan_codes("x")) == [[2], [0, 3], [], [], [], [], []]
    ports = ['{"port":8888}', '{"port":"n/a"}', "{}", None]
    assert column(spark, ports, "string", payload.contacted_port("x")) == [8888, 0, 0, 0]
    protocols = ['{"alerts":{"30":{"proto.ndpi":"SSH"}}}', '{"alerts":{"30":{}}}', "{", None]
    assert column(spark, protocols, "string", payload.detected_protocol("x")) == ["SSH", "", "", ""]


def test_scan_labels(spark):
    rows = spark.createDataFrame([([0, 1, 2, 3, 4, 7],)], "x array<int>")
    assert rows.select(text.scan_labels("x")).first()[0] == [
        "Incomplete Flows", "RX-only (vittima)", "SYN Scan", "FIN Scan", "RST Scan", "Codice sconosciuto (7)"]


def test_byte_labels(spark):
    rng = random.Random(3)
    values = [0, 1023, 1024, 1152, 1048575, 1048576, 1024 ** 3, 5 * 1024 ** 3 + 7]
    values += [rng.randrange(1 << rng.randrange(10, 45)) for _ in range(200)]

    def label(b):
        for unit, size in (("GB", 1024 ** 3), ("MB", 1024 ** 2), ("KB", 1024)):
            if b >= size:
                return f"{b / size:.2f} {unit}"
        return f"{b} B"

    assert column(spark, values, "long", text.format_bytes("x")) == [label(v) for v in values]


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        RiskParams(local_networks=())
    with pytest.raises(ValueError):
        RiskParams(alert_window_minutes=0)
    with pytest.raises(ValueError):
        timewin.alert_window(PARAMS, 0)


def test_reference_instant_forms():
    epoch = 1568966400
    for ref in (epoch, "2019-09-20T08:00:00", "2019-09-20 10:00:00+02:00", datetime(2019, 9, 20, 8)):
        assert RiskParams(flows_ref=ref).flows_epoch == epoch


def test_other_session_zones_are_refused(spark):
    from wardline import MetricInputs

    spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")
    try:
        with pytest.raises(ValueError, match="UTC"):
            MetricInputs(spark.range(1), spark.range(1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_now_is_read_once():
    pinned = RiskParams().pinned()
    assert pinned.flows_epoch == pinned.alerts_epoch == pinned.pinned().flows_epoch
    assert not pinned.replays_alerts and PARAMS.pinned().replays_alerts


def test_windows_prune_days(spark, tmp_path):
    from wardline import schemas
    from wardline.sources.tables import read_host_alerts, write_by_day

    rows = [("10.0.0.1", datetime(2024, 3, d, 12), 15, "{}") for d in range(1, 11)]
    write_by_day(spark.createDataFrame(rows, schemas.HOST_ALERTS), str(tmp_path / "t"), "tstamp")
    table = read_host_alerts(spark, str(tmp_path / "t"), day_column="dt")
    assert dict(table.dtypes)["dt"] == "date"
    start = int(datetime(2024, 3, 4).timestamp())
    recent = timewin.in_windows(table, "tstamp", (start, start + 2 * timewin.DAY))
    assert sorted(r["tstamp"].day for r in recent.collect()) == [4, 5]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "2024-03-04" in plan
    assert len(recent.inputFiles()) == 10 and recent.filter(F.col("dt").isNull()).count() == 0


def test_jdbc_predicates_tile_the_window():
    from wardline.sources.tables import hour_predicates

    parts = hour_predicates("FIRST_SEEN", 1800, 9000)
    assert len(parts) == 2
    assert parts[0] == "FIRST_SEEN >= TIMESTAMP '1970-01-01 00:30:00' AND FIRST_SEEN < TIMESTAMP '1970-01-01 01:30:00'"
    assert parts[-1].endswith("FIRST_SEEN < TIMESTAMP '1970-01-01 02:30:00'")
