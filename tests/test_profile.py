"""The stored and the streamed profile give the same results as the raw flows."""

import random
import warnings
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import REF, address
from wardline import METRICS, RiskParams, schemas, score_network
from wardline.functions.timewin import HOUR, in_windows
from wardline.inputs import MetricInputs
from wardline.operators.baseline import host_activity, hourly_profile
from wardline.operators.flow_metrics import m_fail, m_vol
from wardline.plans import profile, scoring
from wardline.streaming import profile_stream


@pytest.fixture(scope="module")
def flows(spark):
    rng, rows = random.Random(11), []
    for i in range(4000):
        host = 1 if rng.random() < 0.35 else rng.randrange(2, 9)
        seen = REF - timedelta(seconds=rng.randrange(8 * 86400) - 600)
        rows.append((i, 4, seen, seen, address(f"10.0.0.{host}"), address(rng.choice(["8.8.8.8", "10.0.0.9"])),
                     rng.randrange(200 << 20), 1, rng.choice([0, 5, 5]), rng.choice([0, 1 << 43, 1 << 51]),
                     int(rng.random() < 0.05), int(rng.random() < 0.05), 0))
    return spark.createDataFrame(rows, schemas.FLOWS).repartition(8).cache()


def params(**changes):
    return replace(RiskParams(flows_ref=REF, min_baseline_buckets=3, fail_min_flows=2), **changes)


def rows_of(frame):
    return sorted((r.asDict().items() for r in frame.collect()), key=repr)


def activity(frame):
    return sorted(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())


@pytest.mark.parametrize("changes", [
    {},
    {"flows_ref": REF.replace(minute=0)},
    {"flows_ref": REF.replace(minute=0, second=1)},
    {"flows_ref": REF + timedelta(hours=9)},
    {"current_window_hours": 5, "alert_window_minutes": 90},
    {"alert_window_minutes": 1440},
    {"local_tz": "Asia/Kathmandu"},
])
def test_profile_gives_the_direct_result(flows, changes):
    p = params(**changes)
    direct = host_activity(flows, p, "v", "r", with_reputation=True)
    stored = hourly_profile(flows, p)
    from_profile = profile.host_activity_from_profile(
        stored, flows, p, "v", "r", with_reputation=True)
    assert direct.count() > 0
    assert activity(from_profile) == activity(direct)
    plain = profile.host_activity_from_profile(stored, flows, p, "v")
    assert activity(plain) == activity(host_activity(flows, p, "v"))


def test_raw_flows_are_read_for_the_edges_only(flows, spark):
    p = params()
    first, last = profile.whole_hours(p)
    assert first == p.flows_epoch - 7 * 24 * HOUR + 1800 and last == p.flows_epoch - HOUR - 1800
    without_history = in_windows(flows, "FIRST_SEEN", (last, p.flows_epoch), (first - 1800, first))
    stored = hourly_profile(flows, p)
    assert activity(profile.host_activity_from_profile(stored, without_history, p, "v")) == activity(host_activity(flows, p, "v"))


def test_stored_hours_are_replaced_not_added(flows, spark, tmp_path):
    p, path = params(), str(tmp_path / "profile")
    end = profile.whole_hour(p.flows_epoch, p)
    week, last_hours = (end - 9 * 24 * HOUR, end), (end - 3 * HOUR, end)
    profile.write_profile(flows, path, p, week)
    profile.write_profile(flows, path, p, last_hours)  # a late run over hours already there
    stored = profile.read_profile(spark, path)
    direct = hourly_profile(in_windows(flows, "FIRST_SEEN", week), p)
    assert stored.columns == [*direct.columns, "dt", "hh"]
    assert sorted(map(tuple, stored.select(direct.columns).collect())) == sorted(map(tuple, direct.collect()))
    with pytest.raises(ValueError):
        profile.write_profile(flows, path, p, (end - 100, end))


def test_run_with_a_profile(flows, spark):
    p = params()
    inputs = MetricInputs(
        flows=flows, host_alerts=spark.createDataFrame([], schemas.HOST_ALERTS),
        alerted_flows=spark.createDataFrame([], schemas.FLOW_ALERTS))
    run = score_network(inputs, p, profile=hourly_profile(flows, p))
    assert run.metric_status.filter("ok").count() == 8 and run.host_scores.count() > 0
    assert rows_of(run.host_scores) == rows_of(scoring.fused_host_scores(inputs, p))


def test_streamed_partials_add_up(flows, spark, tmp_path):
    p = params()
    source, table, progress = (str(tmp_path / n) for n in ("flows", "table", "progress"))
    halves = flows.withColumn("late", F.col("FLOW_ID") % 2)

    def ingest():
        arriving = spark.readStream.schema(schemas.FLOWS).parquet(source)
        profile_stream.stream_profile(arriving, table, progress, p).awaitTermination()

    for half in (0, 1):  # the second half is late for every hour
        halves.filter(F.col("late") == half).drop("late").coalesce(1).write.mode("append").parquet(source)
        ingest()
    ingest()  # nothing new
    partials = profile_stream.read_partials(spark, table)
    merged = profile_stream.merged_profile(partials)
    expected = sorted(map(tuple, hourly_profile(flows, p).collect()))
    assert partials.count() > len(expected)
    assert sorted(map(tuple, merged.collect())) == expected
    assert activity(profile.host_activity_from_profile(merged, flows, p, "v")) == activity(host_activity(flows, p, "v"))
    profile_stream.compact(spark, table, str(tmp_path / "merged"))
    assert profile.read_profile(spark, str(tmp_path / "merged")).count() == len(expected)


def test_a_checkpoint_that_does_not_know_the_table_is_refused(flows, spark, tmp_path):
    """Batch numbers start anew with it: it would replace batches, or count their flows twice."""
    p, source, table = params(), str(tmp_path / "flows"), str(tmp_path / "table")
    flows.write.parquet(source)
    arriving = spark.readStream.schema(schemas.FLOWS).parquet(source)
    profile_stream.stream_profile(arriving, table, str(tmp_path / "first"), p).awaitTermination()
    with pytest.raises(ValueError, match="does not know"):
        profile_stream.stream_profile(arriving, table, str(tmp_path / "second"), p)
    other = profile_stream.stream_profile(arriving, table, str(tmp_path / "second"), p, stream="again")
    other.awaitTermination()
    merged = profile_stream.merged_profile(profile_stream.read_partials(spark, table))
    assert merged.agg(F.sum("flows")).first()[0] == 2 * hourly_profile(flows, p).agg(F.sum("flows")).first()[0]


def test_nothing_has_arrived_yet(spark, tmp_path):
    assert profile_stream.merged_profile(profile_stream.read_partials(spark, str(tmp_path / "none"))).count() == 0


def test_rewritten_window_keeps_no_stale_hour(flows, spark, tmp_path):
    p, path = params(), str(tmp_path / "profile")
    end = profile.whole_hour(p.flows_epoch, p)
    window = (end - 12 * HOUR, end)
    profile.write_profile(flows, path, p, window)
    fewer = flows.filter("hour(FIRST_SEEN) % 2 = 0")
    profile.write_profile(fewer, path, p, window)
    stored = profile.read_profile(spark, path).drop("dt", "hh")
    direct = hourly_profile(in_windows(fewer, "FIRST_SEEN", window), p)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))


@pytest.mark.parametrize("options", [{"fused": True}, {"fused": False}, {"specs": list(METRICS)},
                                     {"specs": METRICS[:-1]}, {"broken": True}])
def test_profile_serves_every_way_of_running(flows, spark, options):
    """Raw history is not kept: single metrics, own lists of metrics and the fallback read the profile too."""
    p = params()
    seen = REF - timedelta(minutes=10)
    loud = spark.createDataFrame([(9999, 4, seen, seen, address("10.0.0.2"), address("8.8.8.8"), 90 << 30, 1, 5, 0, 0, 0, 0)],
                                 schemas.FLOWS)
    flows = flows.union(loud)
    first, last = profile.whole_hours(p)
    no_alerts = spark.createDataFrame([], schemas.HOST_ALERTS)
    if options.pop("broken", False):
        no_alerts = no_alerts.drop("json")
    direct = MetricInputs(flows=flows, host_alerts=spark.createDataFrame([], schemas.HOST_ALERTS),
                          alerted_flows=spark.createDataFrame([], schemas.FLOW_ALERTS))
    lean = replace(direct, host_alerts=no_alerts, flows=in_windows(
        flows, "FIRST_SEEN", (last, p.flows_epoch), (first - HOUR, first)))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        run = score_network(lean, p, profile=hourly_profile(flows, p), **options)
    wanted = scoring.fused_host_scores(direct, p).filter(
        "true" if len(options.get("specs", METRICS)) == len(METRICS) else "NOT metriche_attive = array('M_fail')")
    assert {r["host_ip"] for r in run.host_scores.collect()} == {r["host_ip"] for r in wanted.collect()}
    assert run.host_scores.filter("array_contains(metriche_attive, 'M_vol')").count() > 0


def test_profile_without_history_is_refused(flows, spark):
    p = params()
    inputs = MetricInputs(flows=flows, host_alerts=spark.createDataFrame([], schemas.HOST_ALERTS))
    with pytest.raises(ValueError, match="no row in the history"):
        score_network(inputs, p, profile=hourly_profile(flows, p).filter("false"))


def test_hours_that_the_profile_misses_are_read_raw_or_refused(flows, spark, tmp_path):
    p, path = params(), str(tmp_path / "profile")
    first, last = profile.whole_hours(p)
    gap = (first + 24 * HOUR, first + 3 * 24 * HOUR)
    for window in ((first, gap[0]), (gap[1], last)):
        profile.write_profile(flows, path, p, window)
    stored = profile.read_profile(spark, path)
    inputs = MetricInputs(flows=flows, host_alerts=spark.createDataFrame([], schemas.HOST_ALERTS),
                          alerted_flows=spark.createDataFrame([], schemas.FLOW_ALERTS), profile=stored)
    assert activity(profile.activity_of(inputs, p, "v", "r")) == activity(host_activity(flows, p, "v", "r"))
    lean = replace(inputs, flows=in_windows(flows, "FIRST_SEEN", (first - HOUR, gap[0]), (gap[1], p.flows_epoch)))
    for run in (lambda: score_network(lean, p), lambda: m_vol(lean, p), lambda: m_fail(lean, p)):
        with pytest.raises(ValueError, match="neither the profile nor the raw flows"):
            run()
    profile.write_profile(flows.filter("false"), path, p, gap)  # known to be empty
    assert profile.uncovered_hours(profile.read_profile(spark, path), p) == []
    quiet = replace(lean, profile=profile.read_profile(spark, path))
    assert activity(profile.activity_of(quiet, p, "v")) == activity(host_activity(lean.flows, p, "v"))


def test_an_idle_hour_is_no_lost_hour(spark, tmp_path):
    """Every kind of profile knows that the network was idle; what is really missing is still refused."""
    p = params(min_baseline_buckets=1)
    idle = (profile.whole_hour(p.flows_epoch, p) - 3 * 24 * HOUR - 4 * HOUR, profile.whole_hour(p.flows_epoch, p) - 3 * 24 * HOUR)
    first, last = profile.whole_hours(p)
    rows = [(h, 4, seen, seen, address("10.0.0.1"), address("8.8.8.8"), 90 << 20 if seen > REF - timedelta(hours=1) else 1, 1, 5, 0, 0, 0, 0)
            for h in range(8 * 24 * 2) for seen in [REF - timedelta(minutes=30 * h + 7)]
            if not idle[0] <= seen.timestamp() < idle[1]]
    flows = spark.createDataFrame(rows, schemas.FLOWS)
    whole = (first - HOUR, p.flows_epoch)
    direct = MetricInputs(flows=flows, host_alerts=spark.createDataFrame([], schemas.HOST_ALERTS),
                          alerted_flows=spark.createDataFrame([], schemas.FLOW_ALERTS))
    expected = activity(profile.activity_of(direct, p, "v"))
    lean = replace(direct, flows=in_windows(flows, "FIRST_SEEN", (first - HOUR, first), (last, p.flows_epoch)))

    place, table, progress = (str(tmp_path / n) for n in ("flows", "table", "progress"))
    flows.write.parquet(place)
    arriving = spark.readStream.schema(schemas.FLOWS).parquet(place)
    profile_stream.stream_profile(arriving, table, progress, p).awaitTermination()
    profile_stream.compact(spark, table, str(tmp_path / "compacted"))
    profile.write_profile(flows, str(tmp_path / "written"), p, (first, last))
    sources = {
        "computed": profile.profile_of(flows, p, (first, last)),
        "declared": profile.covering(hourly_profile(flows, p), whole),
        "streamed": profile_stream.merged_profile(profile_stream.read_partials(spark, table)),
        "compacted": profile.read_profile(spark, str(tmp_path / "compacted")),
        "written": profile.read_profile(spark, str(tmp_path / "written")),
    }
    for name, stored in sources.items():
        assert activity(profile.activity_of(replace(lean, profile=stored), p, "v")) == expected, name
    bare = hourly_profile(flows, p)
    with pytest.raises(ValueError, match="if the network was idle"):
        profile.activity_of(replace(lean, profile=bare), p, "v")
    told = replace(direct, profile=bare, flows_cover=(whole,))
    assert activity(profile.activity_of(told, p, "v")) == expected
    # Compaction notes idle hours, and wipes nothing that came from elsewhere.
    more = flows.limit(1).withColumn("FIRST_SEEN", F.timestamp_seconds(F.lit(idle[0] + 60)))
    profile.write_profile(more, str(tmp_path / "compacted"), p, (idle[0], idle[0] + HOUR))
    profile_stream.compact(spark, table, str(tmp_path / "compacted"))
    kept = profile.read_profile(spark, str(tmp_path / "compacted"))
    assert kept.filter(F.unix_seconds("bucket") == idle[0]).count() == 1
