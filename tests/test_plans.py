"""The physical plans: pushdown, pruning, one scan, no wide state and no Python."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardline import METRICS, MetricInputs, RiskParams, schemas
from wardline.functions import timewin
from wardline.operators import baseline, flow_metrics, host_alerts
from wardline.plans import scoring
from wardline.sources.tables import read_flow_alerts, read_flows, read_host_alerts, write_by_day

P = RiskParams(flows_ref=datetime(2024, 3, 9, 12), min_baseline_buckets=1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Ten days of tables laid out by day, a third of the flows on one host."""
    folder = str(tmp_path_factory.mktemp("stored"))
    base = spark.range(20000).withColumn(
        "ts", F.expr("timestamp'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, id * 43)"))
    flows = base.selectExpr(
        "id AS FLOW_ID", "4 AS IP_PROTOCOL_VERSION", "ts AS FIRST_SEEN", "ts AS LAST_SEEN",
        "CASE WHEN id % 3 = 0 THEN 167772161L ELSE 167772160L + id % 500 END AS IPV4_SRC_ADDR",
        "134744072L AS IPV4_DST_ADDR", "id * 1000 AS SRC2DST_BYTES", "1L AS SRC2DST_PACKETS",
        "id % 4 AS DST2SRC_PACKETS", "CASE WHEN id % 5 = 0 THEN 32L ELSE 64L END AS FLOW_RISK",
        "0 AS IS_SRV_BLACKLISTED", "0 AS IS_CLI_BLACKLISTED", "1 AS STATUS",
        "concat('10.0.0.', id % 200) AS CLI_IP", "CAST(id % 3000 AS INT) AS SRV_PORT", "'{}' AS JSON")
    alerts = base.selectExpr("concat('10.0.0.', id % 200) AS ip", "ts AS tstamp",
                             "CASE WHEN id % 2 = 0 THEN 15 ELSE 29 END AS alert_id",
                             """concat('{"alerts":[', id % 5, '],"port":', id, '}') AS json""")
    write_by_day(flows, f"{folder}/flows", "FIRST_SEEN")
    write_by_day(alerts, f"{folder}/host_alerts", "tstamp")
    return folder


@pytest.fixture
def inputs(spark, stored):
    return MetricInputs(read_flows(spark, f"{stored}/flows", day_column="dt"),
                        read_host_alerts(spark, f"{stored}/host_alerts", day_column="dt"))


def plan_of(frame, run=False):
    if run:
        frame.collect()
    text = frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return text.split("Initial Plan")[0] if run else text


def test_volume_reads_its_columns_and_days_in_one_scan(inputs):
    plan = plan_of(flow_metrics.m_vol(inputs, P))
    assert plan.count("Scan parquet") == 2  # once in the tree, once in its details
    assert "Join" not in plan
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert schema == ("ReadSchema: struct<FIRST_SEEN:timestamp,IPV4_SRC_ADDR:bigint,IPV4_DST_ADDR:bigint,"
                      "SRC2DST_BYTES:bigint>")
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    # A Saturday at noon: of the week before, the weekend days only.
    for edge in ("2024-03-02 12:00:00.0", "2024-03-04 00:00:00.0", "2024-03-09 00:00:00.0", "2024-03-09 12:00:00.0"):
        assert f"(FIRST_SEEN,{edge})" in pushed
    assert "GreaterThanOrEqual(IPV4_SRC_ADDR,167772160)" in pushed
    assert "LessThan(IPV4_DST_ADDR,167772160)" in pushed
    days = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert [d for d in range(1, 10) if f"2024-03-0{d}" in days] == [2, 3, 9]


def test_category_windows_follow_the_local_zone_and_odd_minutes(inputs):
    p = replace(P, flows_ref=datetime(2024, 3, 7, 6, 50), local_tz="Asia/Kathmandu")  # Thursday, 12:35 there
    windows = timewin.category_windows(p)
    every = range(*timewin.history_window(p), 60)
    inside = {t for a, b in windows for t in range(a, b, 60)}
    assert inside == {t for t in every if timewin.category_of(t, p) == timewin.WORKING}
    assert len(windows) <= 8 and all(b > a for a, b in windows)
    rows = sorted(tuple(r) for r in baseline.host_hour(inputs.flows, p).collect())
    history = timewin.in_windows(inputs.flows, "FIRST_SEEN", timewin.history_window(p))
    direct = baseline.hourly_profile(history.filter(baseline.same_category("FIRST_SEEN", p)), p)
    assert rows and rows == sorted(tuple(r) for r in direct.collect())


def test_a_column_that_is_called_dt_filters_nothing(inputs):
    """The date of ingestion, say: only a declared day column may skip days."""
    late = inputs.flows.drop("dt").withColumn("dt", F.to_date(F.lit("2030-01-01")))
    own = MetricInputs(late, inputs.host_alerts)
    a, b = (flow_metrics.m_vol(i, P, only_fired=False).drop("timestamp").collect() for i in (inputs, own))
    assert a and sorted(a) == sorted(b)
    declared = MetricInputs(late, inputs.host_alerts, day_column="dt")
    assert flow_metrics.m_vol(declared, P, only_fired=False).count() == 0


def test_reputation_skips_clean_flows_in_the_reader(inputs):
    pushed = plan_of(flow_metrics.m_rep(inputs, P))
    assert "Or(EqualTo(IS_SRV_BLACKLISTED,1),EqualTo(IS_CLI_BLACKLISTED,1))" in pushed


def test_host_text_filter_reaches_the_reader(inputs):
    plan = plan_of(host_alerts.m_srv(inputs, P))
    assert "StringStartsWith(ip,10.)" in plan and "EqualTo(alert_id,29)" in plan


@pytest.mark.parametrize("key", ["M_srv", "M_proto", "M_scan"])
def test_lists_share_one_scan_and_limit_before_the_shuffle(spark, inputs, key):
    spec = next(s for s in METRICS if s.key == key)
    wide = replace(P, alert_window_minutes=7 * 1440)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        plan = plan_of(spec.fn(inputs, wide), run=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tree = plan.split("\n\n\n")[0]
    assert tree.count("Scan parquet") == 1 and tree.count("ReusedExchange") == 1
    assert tree.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_no_plan_leaves_the_jvm_or_crosses(inputs):
    frames = [spec.fn(inputs, P) for spec in METRICS]
    scores = scoring.fused_host_scores(inputs, P)
    frames += [scores, scoring.network_index(scores, P), scoring.suspect_ranking(scores),
               scoring.suspect_details(scores, P)]
    for frame in frames:
        plan = plan_of(frame)
        assert not [word for word in ("Python", "CartesianProduct", "NestedLoopJoin") if word in plan]


def test_fused_scores_scan_the_flows_once_for_three_metrics(inputs):
    tree = plan_of(scoring.fused_host_scores(inputs, P)).split("\n\n\n")[0]
    # flows; alerted flows and host alerts for their totals and lists, shared when it runs
    assert tree.count("Scan parquet") == 1 + 2 * 2
    assert "SortAggregate" not in tree


def test_fused_scores_run_on_three_scans(spark, inputs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        wide = replace(P, alert_window_minutes=7 * 1440)
        tree = plan_of(scoring.fused_host_scores(inputs, wide), run=True).split("\n\n\n")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tree.count("Scan parquet") == 3


def test_day_with_most_rows_is_split(spark, tmp_path):
    """Writing by day does not put the largest day into one task."""
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "64k")
    try:
        frame = spark.range(200000).selectExpr(
            "concat('10.0.', id % 256, '.', id % 200) AS ip",
            "timestamp'2024-03-01 00:00:00' + make_dt_interval(CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END, 0, 0, id % 80000)"
            " AS tstamp", "15 AS alert_id", "uuid() AS json")
        write_by_day(frame, str(tmp_path / "t"), "tstamp")
    finally:
        spark.conf.set(conf, before)
    files = read_host_alerts(spark, str(tmp_path / "t")).inputFiles()
    assert sum("dt=2024-03-01" in f for f in files) > 4


def test_alert_table_on_its_own(spark, stored, tmp_path, inputs):
    """A stored alerted-flow table gives what the view over the flows gives."""
    write_by_day(inputs.flow_alerts.drop("dt"), str(tmp_path / "alerts"), "tstamp")
    own = replace(inputs, alerted_flows=read_flow_alerts(spark, str(tmp_path / "alerts"), day_column="dt"))
    assert own.flow_alerts.columns == [*schemas.FLOW_ALERTS.names, "dt"]
    for key in ("M_cert", "M_proto"):
        spec = next(s for s in METRICS if s.key == key)
        a, b = (spec.fn(i, P).drop("timestamp").collect() for i in (inputs, own))
        assert a and sorted(a) == sorted(b)
