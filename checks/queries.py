"""The registered queries: every metric, plan and building block on the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import ip, payload, risk, text, timewin
from wardline.inputs import MetricInputs
from wardline.operators import baseline, flow_metrics, networks, replay, verdicts
from wardline.operators.novelty import service_novelty
from wardline.params import RiskParams
from wardline.plans import commits, first_seen, item_hours, profile, registry, run, scoring
from wardline.plans.lineage import ensure_checkpoint_dir
from wardline.sources import events as source
from wardline.sources import tables as stored_tables
from wardline.streaming import metric_stream, profile_stream

# The benchmark events are thin (about one per active user and hour), so the
# windows are wide: one day against the four weeks before it.
NIGHT = RiskParams(
    flows_ref=datetime(2024, 1, 30), alert_window_minutes=1440, current_window_hours=24,
    history_days=28, min_baseline_buckets=3, fail_min_flows=3)
WORKDAY = replace(NIGHT, flows_ref=datetime(2024, 1, 29, 15))
SATURDAY = replace(NIGHT, flows_ref=datetime(2024, 1, 27, 15))
LOW = replace(NIGHT, list_limit=1, rep_srv_persistent_from=2, rep_cli_targeted_from=1)
ODD_MINUTE = replace(NIGHT, flows_ref=datetime(2024, 1, 29, 15, 20))

Query = Callable[[SparkSession, str], DataFrame]


def tables(spark: SparkSession, folder: str) -> MetricInputs:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return source.tables_from_events(spark, folder).inputs()


def flat(df: DataFrame) -> DataFrame:
    """Plain columns only: lists as text, structs spread out, instants as text."""
    columns: list[Column] = []
    for field in df.drop("timestamp").schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            columns.append(F.array_join(column.cast("array<string>"), "|").alias(field.name))
        elif isinstance(field.dataType, T.StructType):
            columns += [column[f.name].alias(f"{field.name}_{f.name}") for f in field.dataType.fields]
        elif isinstance(field.dataType, T.TimestampType):
            columns.append(F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(field.name))
        else:
            columns.append(column)
    return df.select(*columns)


def _metric(key: str, p: RiskParams = NIGHT) -> Query:
    spec = next(s for s in registry.METRICS if s.key == key)
    return lambda spark, folder: flat(registry.metric_report(spec, tables(spark, folder), p))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.fused_host_scores(tables(spark, folder), NIGHT)


def _score_columns(scores: DataFrame) -> DataFrame:
    return scores.select("host_ip", "score", "fascia",
                         F.array_join("metriche_attive", ", ").alias("metriche_attive"), "penalita_totale")


def host_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _score_columns(_scores(spark, folder))


def host_scores_by_metric(spark: SparkSession, folder: str) -> DataFrame:
    inputs = tables(spark, folder)
    frames = {spec.key: spec.fn(inputs, NIGHT) for spec in registry.METRICS}
    return _score_columns(scoring.host_scores(frames, NIGHT))


def host_scores_from_profile(spark: SparkSession, folder: str) -> DataFrame:
    inputs = tables(spark, folder)
    stored = baseline.hourly_profile(inputs.flows, ODD_MINUTE)
    activity = profile.host_activity_from_profile(
        stored, inputs.flows, ODD_MINUTE, "v", "r", with_reputation=True)
    return _score_columns(scoring.fused_host_scores(inputs, ODD_MINUTE, activity))


def risk_bands(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).groupBy(
        scoring.risk_band("score", NIGHT).alias("fascia"), "score").agg(F.count(F.lit(1)).alias("hosts"))


def network_index(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.network_index(_scores(spark, folder), NIGHT)


def network_state(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.network_state(network_index(spark, folder), NIGHT)


def suspect_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return flat(scoring.suspect_ranking(_scores(spark, folder), NIGHT))


def suspect_details(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.suspect_details(_scores(spark, folder), NIGHT)


def metric_status(spark: SparkSession, folder: str) -> DataFrame:
    _, status = registry.run_metrics(tables(spark, folder), NIGHT)
    return status.select("metric", "label", "ok", "n_hosts")


def metric_status_one_failing(spark: SparkSession, folder: str) -> DataFrame:
    """M_scan fails when it is computed; the others stay and it counts as without hosts."""
    def failing(inputs: MetricInputs, p: RiskParams) -> DataFrame:
        return inputs.host_alerts.select(
            F.raise_error(F.lit("no alerts")).cast("string").alias("host_ip"), F.lit(1).alias("penalita"))

    specs = [replace(s, fn=failing) if s.key == "M_scan" else s for s in registry.METRICS]
    return run.score_network(tables(spark, folder), NIGHT, specs=specs).metric_status.select(
        "metric", "label", "ok", "n_hosts")


def host_items(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.host_items(tables(spark, folder), NIGHT)


def _stored_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items of the day before an odd minute: stored hours, less three that were never stored, and raw alerts for the rest."""
    inputs, place, p = tables(spark, folder), _place(spark, "items"), ODD_MINUTE
    start, end = timewin.alert_window(p)
    first, last = timewin.whole_hour(start + timewin.HOUR - 1, p), timewin.whole_hour(end, p)
    for window in ((first, first + 9 * timewin.HOUR), (first + 12 * timewin.HOUR, last)):
        for _ in range(2):
            item_hours.write_item_hours(inputs, place, p, window)
    return item_hours.items_of_window(spark, place, inputs, p, (start, end))


def distinct_items_stored(spark: SparkSession, folder: str) -> DataFrame:
    return item_hours.distinct_items(_stored_items(spark, folder))


def host_items_stored(spark: SparkSession, folder: str) -> DataFrame:
    return item_hours.listed_items(_stored_items(spark, folder))


def _place(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scores_isolated_from_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Each metric on its own, history from the stored profile; raw flows are kept for its edges only."""
    inputs, place = tables(spark, folder), _place(spark, "profile")
    hours = profile.whole_hours(ODD_MINUTE)
    profile.write_profile(inputs.flows, place, ODD_MINUTE, hours)
    raw = inputs.flows.filter(~timewin.between("FIRST_SEEN", hours))
    lean = replace(inputs, flows=raw, alerted_flows=inputs.flow_alerts, profile=profile.read_profile(spark, place))
    return _score_columns(run.score_network(lean, ODD_MINUTE, fused=False).host_scores)


def scores_of_foreign_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables as a database gives them: decimal bitmaps and addresses, boolean flags, other case."""
    inputs = tables(spark, folder)
    foreign = inputs.flows.select(*[
        (F.col(c) == 1 if c.startswith("IS_") else F.col(c).cast("decimal(20,0)") if kind == "bigint" else F.col(c))
        .alias(c.lower()) for c, kind in inputs.flows.dtypes])
    alerts = inputs.host_alerts.select(
        F.col("ip").alias("IP"), "tstamp", F.col("alert_id").cast("decimal(10,0)").alias("ALERT_ID"), "json")
    return _score_columns(scoring.fused_host_scores(
        MetricInputs(stored_tables.flows_of(foreign), stored_tables.host_alerts_of(alerts)), NIGHT))


def _stored_inputs(spark: SparkSession, folder: str, place: str) -> MetricInputs:
    inputs = tables(spark, folder)
    for _ in range(2):  # a job that runs again doubles nothing
        stored_tables.write_by_day(inputs.host_alerts, f"{place}/host_alerts", "tstamp")
    stored_tables.write_by_day(inputs.flows, f"{place}/flows", "FIRST_SEEN")
    return MetricInputs(stored_tables.read_flows(spark, f"{place}/flows", day_column="dt"),
                        stored_tables.read_host_alerts(spark, f"{place}/host_alerts", day_column="dt"))


def score_run_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Tables written by day, read back, scored, the results written and read again."""
    place = _place(spark, "stored")
    run.score_network(_stored_inputs(spark, folder, place), NIGHT).write(f"{place}/results")
    return _score_columns(spark.read.parquet(f"{place}/results/host_scores"))


def score_run_committed(spark: SparkSession, folder: str) -> DataFrame:
    """An older run, then this one, each as one commit; the current version is read."""
    inputs, place = tables(spark, folder), _place(spark, "runs")
    for p in (SATURDAY, NIGHT):
        run.score_network(inputs, p).commit(place)
    return _score_columns(commits.read_committed(spark, place)["host_scores"])


def score_run_stored_from_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stored profile."""
    place = _place(spark, "stored")
    inputs = _stored_inputs(spark, folder, place)
    profile.write_profile(inputs.flows, f"{place}/profile", NIGHT, timewin.history_window(NIGHT))
    run.score_network(inputs, NIGHT, profile=profile.read_profile(spark, f"{place}/profile")).write(f"{place}/results")
    return _score_columns(spark.read.parquet(f"{place}/results/host_scores"))


#: A working hour of the history in which the network is idle.
IDLE = (1705917600, 1705921200)  # 2024-01-22, 10 to 11 o'clock


def score_run_streamed_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Scores from a streamed and compacted profile; raw flows are kept for the current day alone, and an hour was idle."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    place, busy = _place(spark, "profile"), ~timewin.between("ts", IDLE)
    flows = source.flows_from_events(_arriving(spark, folder).filter(busy))
    profile_stream.stream_profile(flows, f"{place}/table", f"{place}/progress", WORKDAY,
                                  since=timewin.history_window(WORKDAY)[0]).awaitTermination()
    profile_stream.compact(spark, f"{place}/table", f"{place}/profile")
    events = source.read_events(spark, f"{folder}/events.parquet").filter(busy)
    recent = timewin.in_windows(source.flows_from_events(events), "FIRST_SEEN", timewin.current_window(WORKDAY))
    inputs = MetricInputs(recent, source.host_alerts_from_events(events))
    stored = profile.read_profile(spark, f"{place}/profile")
    return _score_columns(run.score_network(inputs, WORKDAY, profile=stored).host_scores)


def profile_rewritten(spark: SparkSession, folder: str) -> DataFrame:
    """The whole history written again, from failed flows only, keeps none of the old hours."""
    flows, place = tables(spark, folder).flows, _place(spark, "profile")
    window = timewin.history_window(NIGHT)
    profile.write_profile(flows, place, NIGHT, window)
    profile.write_profile(flows.filter(risk.is_failed(NIGHT)), place, NIGHT, window)
    return flat(profile.read_profile(spark, place).drop("dt", "hh"))


def flagged_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.flagged_hosts(_scores(spark, folder))


def m_vol_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    return flat(flow_metrics.m_vol(tables(spark, folder), NIGHT, only_fired=False))


def m_fail_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    return flat(flow_metrics.m_fail(tables(spark, folder), NIGHT, only_fired=False))


def _replayed(key: str) -> Query:
    """The metric at every hour of a week, all time categories among them."""
    week = (NIGHT.flows_epoch - 7 * timewin.DAY, NIGHT.flows_epoch + timewin.HOUR)
    return lambda spark, folder: flat(replay.hourly_replay(tables(spark, folder).flows, NIGHT, *week)[key])


def dominant_cause(spark: SparkSession, folder: str) -> DataFrame:
    judged = flow_metrics.m_fail(tables(spark, folder), NIGHT, only_fired=False)
    return judged.select("host_ip", verdicts.dominant_cause("breakdown").alias("d")).select(
        "host_ip", "d.causa", "d.conteggio")


def scan_code_labels(spark: SparkSession, folder: str) -> DataFrame:
    alerts = tables(spark, folder).host_alerts.filter("alert_id = 15")
    return (
        alerts.select(F.explode(payload.scan_codes("json")).alias("code"))
        .groupBy("code").agg(F.count(F.lit(1)).alias("alerts"))
        .select("code", text.scan_label("code").alias("label"), "alerts")
    )


def novelty(spark: SparkSession, folder: str) -> DataFrame:
    flows = tables(spark, folder).flows.filter(baseline.is_subject(NIGHT))
    novel = service_novelty(flows, NIGHT, "IPV4_SRC_ADDR", "FIRST_SEEN", "SRV_PORT")
    return novel.select(ip.ipv4_to_string("IPV4_SRC_ADDR").alias("host_ip"),
                        F.col("SRV_PORT").alias("srv_port"))


def novelty_from_sightings(spark: SparkSession, folder: str) -> DataFrame:
    """The same from stored sightings: four days each, stored twice, the older ones merged; of the flows one day is read."""
    place, (start, end) = _place(spark, "sightings"), timewin.history_window(NIGHT)
    flows = tables(spark, folder).flows.filter(baseline.is_subject(NIGHT))
    columns = ("IPV4_SRC_ADDR", "FIRST_SEEN", "SRV_PORT")
    cuts = [*range(start - timewin.DAY, end, 4 * timewin.DAY), end]
    for window in zip(cuts, cuts[1:]):
        for _ in range(2):
            first_seen.add_sightings(flows, place, window, *columns)
    first_seen.compact(spark, place, before=cuts[-3])
    novel = first_seen.novelty_from_sightings(flows, place, NIGHT, *columns)
    return novel.select(ip.ipv4_to_string("IPV4_SRC_ADDR").alias("host_ip"), F.col("SRV_PORT").alias("srv_port"))


def flows_scan(spark: SparkSession, folder: str) -> DataFrame:
    return flat(tables(spark, folder).flows)


def flow_alerts_view(spark: SparkSession, folder: str) -> DataFrame:
    return flat(tables(spark, folder).flow_alerts)


def host_alerts_scan(spark: SparkSession, folder: str) -> DataFrame:
    return flat(tables(spark, folder).host_alerts)


def _counted(df: DataFrame, name: str, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def network_membership(spark: SparkSession, folder: str) -> DataFrame:
    return _counted(
        tables(spark, folder).flows, "flows",
        baseline.is_subject(NIGHT).alias("subject"),
        baseline.goes_outside(NIGHT).alias("outside"),
        ip.is_local_text("CLI_IP", NIGHT).alias("local_text"),
    )


def network_table(spark: SparkSession, folder: str) -> DataFrame:
    """The most specific network of each flow's source and the flows of each; one network per customer, of 20 to 32 bits."""
    bits = "20 + c_custkey % 13"
    first = "shiftleft(shiftright(167772160 + c_custkey, 12 - c_custkey % 13), 12 - c_custkey % 13)"
    text = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.expr(first).alias("first"), F.expr(bits).alias("bits")).select(
        F.concat_ws("/", ip.ipv4_to_string("first"), F.col("bits").cast("string")).alias("network"))
    rows = tables(spark, folder).flows.groupBy(F.col("IPV4_SRC_ADDR").alias("src")).agg(F.count("*").alias("flows"))
    tagged = networks.with_network(rows, "src", networks.network_keys(text))
    return tagged.groupBy("network").agg(F.count("*").alias("hosts"), F.sum("flows").alias("flows"))


def address_conversion(spark: SparkSession, folder: str) -> DataFrame:
    address = "IPV4_SRC_ADDR"
    return _counted(
        tables(spark, folder).flows, "flows",
        F.col(address).alias("address"), ip.ipv4_to_string(address).alias("text"),
        ip.ipv4_to_long("CLI_IP").alias("parsed"),
    )


def time_categories(spark: SparkSession, folder: str) -> DataFrame:
    ts = "FIRST_SEEN"
    hours = _counted(
        tables(spark, folder).flows, "flows",
        (F.weekday(ts) + 1).alias("giorno"), F.hour(ts).alias("ora"),
        timewin.time_category(ts, NIGHT).alias("categoria"), timewin.hour_bucket(ts, NIGHT).alias("bucket"),
    )
    return hours.groupBy("giorno", "ora", "categoria").agg(
        F.sum("flows").alias("flows"), F.count(F.lit(1)).alias("buckets"))


def time_windows(spark: SparkSession, folder: str) -> DataFrame:
    p = replace(ODD_MINUTE, alert_window_minutes=60)
    windows = {
        "correnti": timewin.current_window(p),
        "storici": timewin.history_window(p),
        "ultima_ora": timewin.alert_window(p),
        "senza_limite": (timewin.alert_window(p)[0], None),
    }
    return tables(spark, folder).flows.agg(*[
        F.count_if(timewin.between("FIRST_SEEN", window)).alias(name) for name, window in windows.items()])


def risk_bits(spark: SparkSession, folder: str) -> DataFrame:
    bitmap, p = "FLOW_RISK", NIGHT
    return _counted(
        tables(spark, folder).flows, "flows",
        F.col(bitmap).alias("bitmap"),
        risk.has_any_bit(bitmap, p.bit_nonstandard_port).alias("nonstandard_port"),
        risk.has_any_bit(bitmap, p.bit_missing_sni).alias("missing_sni"),
        risk.has_any_bit(bitmap, *p.cert_bits).alias("certificate"),
        risk.is_failed(p).alias("failed"),
    )


def alert_payloads(spark: SparkSession, folder: str) -> DataFrame:
    inputs, json = tables(spark, folder), "json"

    def kind(df: DataFrame, name: str, value: Column) -> DataFrame:
        return _counted(df, "alerts", F.lit(name).alias("kind"), value.alias("valore"))

    codes = F.array_join(payload.scan_codes(json).cast("array<string>"), "|")
    return (
        kind(inputs.host_alerts.filter("alert_id = 15"), "codes", codes)
        .unionByName(kind(inputs.host_alerts.filter("alert_id = 29"), "port",
                          payload.contacted_port(json).cast("string")))
        .unionByName(kind(inputs.flow_alerts, "proto", payload.detected_protocol(json)))
    )


def scan_severity(spark: SparkSession, folder: str) -> DataFrame:
    from wardline.operators.host_alerts import alerted_hosts

    alerts = alerted_hosts(tables(spark, folder).host_alerts, NIGHT, None, NIGHT.scan_alert_id)
    rating = verdicts.scan_severity("codes", NIGHT)
    return _counted(
        alerts.withColumn("codes", payload.scan_codes("json")), "alerts",
        F.array_join(F.col("codes").cast("array<string>"), "|").alias("codici"),
        rating["penalty"].alias("penalita"), rating["category"].alias("categoria"),
    )


def host_hour(spark: SparkSession, folder: str) -> DataFrame:
    return flat(baseline.host_hour(tables(spark, folder).flows, NIGHT))


def hourly_profile(spark: SparkSession, folder: str) -> DataFrame:
    return flat(baseline.hourly_profile(tables(spark, folder).flows, NIGHT))


def streamed_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly profile again, taken in as a stream and merged on reading."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    place = _place(spark, "profile")
    query = profile_stream.stream_profile(
        source.flows_from_events(_arriving(spark, folder)), f"{place}/table", f"{place}/progress", NIGHT)
    query.awaitTermination()
    return flat(profile_stream.merged_profile(profile_stream.read_partials(spark, f"{place}/table")))


def _arriving(spark: SparkSession, folder: str) -> DataFrame:
    """The table as a stream of files; a pattern names it, be it one file or a folder of files."""
    return spark.readStream.schema(source.EVENTS).parquet(f"{folder}/events.parque[t]")


#: Rows of the streamed metrics come up to 90 minutes late; the watermark allows two hours.
LATEST_ARRIVAL, DELAY, ARRIVALS = 5400, "2 hours", 3
#: What the hits of a metric are called, and the detail that the query shows.
STREAMED = {
    "M_rep": ("hits_totali", "scenario"), "M_cert": ("hits_totali", "CAST(hits_sha1 AS STRING)"), "M_sni": ("hits_missing", "''"),
    "M_proto": ("hits_totali", "array_join(lista_mismatch, '|')"), "M_srv": ("hits_totali", "array_join(lista_porte, '|')"),
    "M_scan": ("hits_totali", "concat(categoria_dominante, '|', array_join(codici_rilevati, '|'))")}


def streamed_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """M_rep to M_scan of every hour that the watermark has closed, from a stream of several runs, out of order."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    place, p = _place(spark, "metrics"), replace(NIGHT, alert_window_minutes=60)
    events = source.read_events(spark, f"{folder}/events.parquet").withColumn(
        "arrival", F.expr(f"unix_seconds(ts) + pmod(hash(event_id), {LATEST_ARRIVAL})"))
    first, last = events.agg(F.coalesce(F.min("arrival"), F.lit(0)), F.coalesce(F.max("arrival"), F.lit(0))).first()
    families = (metric_stream.REPUTATION, metric_stream.ALERTED_FLOWS, metric_stream.HOST_ALERTS)
    for part in range(ARRIVALS):
        cut = [first + (last + 1 - first) * i // ARRIVALS for i in (part, part + 1)]
        events.filter(F.col("arrival").between(cut[0], cut[1] - 1)).drop("arrival").write.mode("append").parquet(f"{place}/events")
        arriving = spark.readStream.schema(source.EVENTS).parquet(f"{place}/events")
        flows = source.flows_from_events(arriving)
        rows = (flows, stored_tables.flow_alerts_view(flows), source.host_alerts_from_events(arriving))
        running = [metric_stream.stream_family(
            stream, family, f"{place}/{family.name}", f"{place}/progress-{family.name}", p, DELAY)
            for stream, family in zip(rows, families)]
        for query in running:
            query.awaitTermination()
    found = [
        fired.selectExpr(f"'{key}' AS metric", "date_format(ref, 'yyyy-MM-dd HH:mm:ss') AS ref", "host_ip",
                         f"{STREAMED[key][0]} AS hits", f"{STREAMED[key][1]} AS dettaglio", "penalita")
        for family in families
        for key, fired in metric_stream.closed_windows(spark, family, f"{place}/{family.name}", p).items()]
    return reduce(DataFrame.union, found)


def stream_restarted(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams into one table, each from its own batch 0: neither loses what the other has written."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    place = _place(spark, "profile")
    flows = source.flows_from_events(_arriving(spark, folder))
    for part in range(2):
        profile_stream.stream_profile(
            flows.filter(f"FLOW_ID % 2 = {part}"), f"{place}/table", f"{place}/progress-{part}", NIGHT,
            stream=f"part-{part}").awaitTermination()
    profile_stream.compact(spark, f"{place}/table", f"{place}/profile")
    return flat(profile.read_profile(spark, f"{place}/profile").drop("dt", "hh"))


def contextual_baseline(spark: SparkSession, folder: str) -> DataFrame:
    samples = baseline.host_hour(tables(spark, folder).flows, NIGHT)
    return baseline.contextual_baseline(
        samples, "host",
        {"volume": F.col("bytes_out"), "rate": F.col("failed").cast("double") / F.col("flows")},
        NIGHT.min_baseline_buckets,
    )


def byte_labels(spark: SparkSession, folder: str) -> DataFrame:
    sums = tables(spark, folder).flows.groupBy("IPV4_SRC_ADDR").agg(F.sum("SRC2DST_BYTES").alias("bytes"))
    return sums.select(ip.ipv4_to_string("IPV4_SRC_ADDR").alias("host_ip"), "bytes",
                       text.format_bytes("bytes").alias("label"))


def queries() -> dict[str, Query]:
    return {
        "m_rep": _metric("M_rep"),
        "m_cert": _metric("M_cert"),
        "m_sni": _metric("M_sni"),
        "m_srv": _metric("M_srv"),
        "m_proto": _metric("M_proto"),
        "m_scan": _metric("M_scan"),
        "m_vol": _metric("M_vol"),
        "m_vol_working_hours": _metric("M_vol", WORKDAY),
        "m_vol_weekend": _metric("M_vol", SATURDAY),
        "m_vol_diagnostic": m_vol_diagnostic,
        "m_fail": _metric("M_fail"),
        "m_fail_working_hours": _metric("M_fail", WORKDAY),
        "m_fail_weekend": _metric("M_fail", SATURDAY),
        "m_fail_diagnostic": m_fail_diagnostic,
        "m_vol_replay": _replayed("M_vol"),
        "m_fail_replay": _replayed("M_fail"),
        "dominant_cause": dominant_cause,
        "scan_code_labels": scan_code_labels,
        "host_scores": host_scores,
        "host_scores_by_metric": host_scores_by_metric,
        "host_scores_from_profile": host_scores_from_profile,
        "risk_bands": risk_bands,
        "network_index": network_index,
        "network_state": network_state,
        "suspect_ranking": suspect_ranking,
        "suspect_details": suspect_details,
        "metric_status": metric_status,
        "metric_status_one_failing": metric_status_one_failing,
        "host_items": host_items,
        "host_items_stored": host_items_stored,
        "distinct_items_stored": distinct_items_stored,
        "m_rep_low_tiers": _metric("M_rep", LOW),
        "m_srv_short": _metric("M_srv", LOW),
        "m_proto_short": _metric("M_proto", LOW),
        "m_scan_short": _metric("M_scan", LOW),
        "scores_isolated_from_profile": scores_isolated_from_profile,
        "scores_of_foreign_tables": scores_of_foreign_tables,
        "score_run_stored": score_run_stored,
        "score_run_committed": score_run_committed,
        "score_run_stored_from_profile": score_run_stored_from_profile,
        "score_run_streamed_profile": score_run_streamed_profile,
        "profile_rewritten": profile_rewritten,
        "stream_restarted": stream_restarted,
        "flagged_hosts": flagged_hosts,
        "service_novelty": novelty,
        "service_novelty_stored": novelty_from_sightings,
        "flows_scan": flows_scan,
        "flow_alerts_view": flow_alerts_view,
        "host_alerts_scan": host_alerts_scan,
        "network_membership": network_membership,
        "network_table": network_table,
        "address_conversion": address_conversion,
        "time_categories": time_categories,
        "time_windows": time_windows,
        "risk_bits": risk_bits,
        "alert_payloads": alert_payloads,
        "scan_severity": scan_severity,
        "host_hour": host_hour,
        "hourly_profile": hourly_profile,
        "streamed_profile": streamed_profile,
        "streamed_metrics": streamed_metrics,
        "contextual_baseline": contextual_baseline,
        "byte_labels": byte_labels,
    }
