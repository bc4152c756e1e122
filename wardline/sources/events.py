"""Flow and alert tables read out of a generic event table.

The benchmark tables hold no network flows. A fixed projection of `events`
stands in for them: it keeps the users, instants and volumes of the events and
draws addresses, risks and alert payloads from the number k in `props`. All
columns are plain expressions, so the rows grow with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.inputs import MetricInputs

# Reading ts as an instant keeps time filters in the parquet reader.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# Fixed values of the projection.
CLIENT_NET = 167772160  # 10.0.0.0
PUBLIC_NET = 3405803776  # 203.0.113.0
LAN_SERVER = 3232235776  # 192.168.1.0
LAN_SERVER_2 = 2886991872  # 172.20.0.0
OUTSIDE = 134744072  # 8.8.8.8
RISK_BITS = (5, 6, 9, 24, 29, 43, 46, 50, 51, 55)
PROTOCOLS = ("TLS", "SSH", "HTTP", "IRC")
DOTTED = "concat_ws('.', {ip} DIV 16777216, {ip} DIV 65536 % 256, {ip} DIV 256 % 256, {ip} % 256)"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path)


@dataclass(frozen=True)
class EventTables:
    flows: DataFrame
    host_alerts: DataFrame

    def inputs(self) -> MetricInputs:
        return MetricInputs(flows=self.flows, host_alerts=self.host_alerts)


def _with_k(events: DataFrame) -> DataFrame:
    # A generated column is computed once per row; a projected one would be
    # copied, JSON parsing included, into every predicate that mentions it.
    return events.selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        "inline(array(named_struct('k', CAST(get_json_object(props, '$.k') AS INT))))")


def flows_from_events(events: DataFrame) -> DataFrame:
    main_risk = " ".join(f"WHEN {i} THEN {1 << bit}L" for i, bit in enumerate(RISK_BITS))
    protocols = ", ".join(f"'{name}'" for name in PROTOCOLS)
    return (
        _with_k(events)
        .withColumns({
            # k = 13 is a pure IPv6 flow, k = 17 has a source outside the networks
            "src": F.expr(f"CASE k WHEN 13 THEN 0L WHEN 17 THEN {PUBLIC_NET}L + user_id % 256"
                          f" ELSE {CLIENT_NET}L + user_id END"),
            "second_risk": F.expr(f"CASE WHEN k % 4 = 0 THEN {1 << 5}L WHEN k % 3 = 0 THEN {1 << 29}L"
                                  f" WHEN k % 7 = 0 THEN {1 << 51}L ELSE 0L END"),
            "protocol": F.expr(f"array({protocols})[(k DIV 4) % {len(PROTOCOLS)}]"),
        })
        .withColumn("risk", F.expr(
            f"CASE WHEN k % 20 < {len(RISK_BITS)} THEN (CASE k % 20 {main_risk} END) | second_risk ELSE 0L END"))
        .selectExpr(
            "event_id AS FLOW_ID",
            "4 AS IP_PROTOCOL_VERSION",
            "ts AS FIRST_SEEN",
            "ts + INTERVAL 5 SECONDS AS LAST_SEEN",
            "src AS IPV4_SRC_ADDR",
            f"CASE WHEN k % 5 = 0 THEN {LAN_SERVER}L + k WHEN k % 25 = 1 THEN {LAN_SERVER_2}L + k"
            f" ELSE {OUTSIDE}L + k END AS IPV4_DST_ADDR",
            "CAST(floor(value * 1048576) AS BIGINT) AS SRC2DST_BYTES",
            "1L AS SRC2DST_PACKETS",
            "CASE WHEN event_type = 'error' THEN 0L ELSE 5L END AS DST2SRC_PACKETS",
            "risk AS FLOW_RISK",
            "CAST(k % 37 = 0 AS INT) AS IS_SRV_BLACKLISTED",
            "CAST(k % 41 = 0 AS INT) AS IS_CLI_BLACKLISTED",
            "CAST(risk != 0 AS INT) AS STATUS",
            f"CASE WHEN k = 13 THEN concat('fd00::', user_id) ELSE {DOTTED.format(ip='src')} END AS CLI_IP",
            "1000 + k AS SRV_PORT",
            """CASE WHEN k % 40 = 0 THEN '{}'
               ELSE concat('{"alerts":{"30":{"proto.ndpi":"', protocol, '"}}}') END AS JSON""",
        )
    )


def host_alerts_from_events(events: DataFrame) -> DataFrame:
    return (
        _with_k(events.filter("event_type IN ('signup', 'view')"))
        .withColumn("address", F.expr(
            f"CASE k WHEN 17 THEN {PUBLIC_NET}L + user_id % 256 ELSE {CLIENT_NET}L + user_id END"))
        .selectExpr(
            f"{DOTTED.format(ip='address')} AS ip",
            "ts AS tstamp",
            "CASE event_type WHEN 'signup' THEN 15 ELSE 29 END AS alert_id",
            """CASE
               WHEN event_type = 'signup' AND k % 11 = 0 THEN '{}'
               WHEN event_type = 'signup' AND k % 3 = 0 THEN concat('{"alerts":[', k % 5, ',', k % 7, ']}')
               WHEN event_type = 'signup' THEN concat('{"alerts":[', k % 5, ']}')
               WHEN k % 13 = 0 THEN '{"port":"n/a"}'
               ELSE concat('{"port":', k, '}') END AS json""",
        )
    )


def tables_from_events(spark: SparkSession, folder: str) -> EventTables:
    events = read_events(spark, f"{folder}/events.parquet")
    return EventTables(flows_from_events(events), host_alerts_from_events(events))
