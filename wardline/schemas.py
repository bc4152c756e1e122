"""Schemas of the input tables. They are declared, never inferred."""

from pyspark.sql import types as T

FLOWS = T.StructType([
    T.StructField("FLOW_ID", T.LongType()),
    T.StructField("IP_PROTOCOL_VERSION", T.IntegerType()),
    T.StructField("FIRST_SEEN", T.TimestampType()),
    T.StructField("LAST_SEEN", T.TimestampType()),
    T.StructField("IPV4_SRC_ADDR", T.LongType()),
    T.StructField("IPV4_DST_ADDR", T.LongType()),
    T.StructField("SRC2DST_BYTES", T.LongType()),
    T.StructField("SRC2DST_PACKETS", T.LongType()),
    T.StructField("DST2SRC_PACKETS", T.LongType()),
    T.StructField("FLOW_RISK", T.LongType()),
    T.StructField("IS_SRV_BLACKLISTED", T.IntegerType()),
    T.StructField("IS_CLI_BLACKLISTED", T.IntegerType()),
    T.StructField("STATUS", T.IntegerType()),
])

# Columns a flow table carries as well when the alerted-flow view is read from it.
FLOW_ALERT_EXTRAS = T.StructType([
    T.StructField("CLI_IP", T.StringType()),
    T.StructField("SRV_PORT", T.IntegerType()),
    T.StructField("JSON", T.StringType()),
])

FLOW_ALERTS = T.StructType([
    T.StructField("cli_ip", T.StringType()),
    T.StructField("tstamp", T.TimestampType()),
    T.StructField("flow_risk_bitmap", T.LongType()),
    T.StructField("srv_port", T.IntegerType()),
    T.StructField("json", T.StringType()),
])

HOST_ALERTS = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("tstamp", T.TimestampType()),
    T.StructField("alert_id", T.IntegerType()),
    T.StructField("json", T.StringType()),
])

# One row per host and hour: the statistical sample behind the baselines.
PROFILE = T.StructType([
    T.StructField("host", T.LongType()),
    T.StructField("bucket", T.TimestampType()),
    T.StructField("bytes_out", T.LongType()),
    T.StructField("flows", T.LongType()),
    T.StructField("failed", T.LongType()),
])
