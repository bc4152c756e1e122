"""Reading flow and alert tables, and writing tables and results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import schemas
from wardline.functions.timewin import HOUR, PARTITION_COLUMN, day_column, laid_out_by_day


def _place(spark: SparkSession, path: str):
    """The file system that a path names, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written; a missing one is no error."""
    system, place = _place(spark, path)
    system.delete(place, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, place = _place(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def create_marker(spark: SparkSession, path: str) -> None:
    """An empty file; that it is there already is an error."""
    system, place = _place(spark, path)
    system.create(place, False).close()


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """Any file source, with the declared schema.

    Spark adds the partition column of a daily layout by itself.
    """
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_flows(spark: SparkSession, path: str, fmt: str = "parquet", day_column: str | None = None,
               **options: str) -> DataFrame:
    """Flows; `day_column` names the partition column of a layout by day, as write_by_day makes it."""
    schema = T.StructType([*schemas.FLOWS.fields, *schemas.FLOW_ALERT_EXTRAS.fields])
    return laid_out_by_day(read_table(spark, path, schema, fmt, **options), "FIRST_SEEN", day_column)


def read_flow_alerts(spark: SparkSession, path: str, fmt: str = "parquet", day_column: str | None = None,
                     **options: str) -> DataFrame:
    return laid_out_by_day(read_table(spark, path, schemas.FLOW_ALERTS, fmt, **options), "tstamp", day_column)


def read_host_alerts(spark: SparkSession, path: str, fmt: str = "parquet", day_column: str | None = None,
                     **options: str) -> DataFrame:
    return laid_out_by_day(read_table(spark, path, schemas.HOST_ALERTS, fmt, **options), "tstamp", day_column)


def with_types(df: DataFrame, *declared: T.StructType) -> DataFrame:
    """A foreign table under the declared names and types.

    Names are matched without regard to case. Flags may come as booleans, and addresses and
    bitmaps as decimals, as databases give unsigned numbers. Values that don't fit
    fail the query, they never become others. Columns that the table lacks are left out; others are kept.
    """
    known = {c.lower(): c for c in df.columns}
    fields = [f for schema in declared for f in schema.fields if f.name.lower() in known]
    taken = {known[f.name.lower()] for f in fields}
    return df.select(
        *[F.col(f"`{known[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in fields],
        *[F.col(f"`{c}`") for c in df.columns if c not in taken])


def flows_of(df: DataFrame) -> DataFrame:
    return with_types(df, schemas.FLOWS, schemas.FLOW_ALERT_EXTRAS)


def host_alerts_of(df: DataFrame) -> DataFrame:
    return with_types(df, schemas.HOST_ALERTS)


def hour_predicates(ts: str, start: int, end: int) -> list[str]:
    """One half-open predicate per hour of [start, end), for a partitioned JDBC read."""
    def text(epoch: int) -> str:
        return datetime.fromtimestamp(epoch, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")

    cuts = [*range(start, end, HOUR), end]
    return [
        f"{ts} >= TIMESTAMP '{text(lo)}' AND {ts} < TIMESTAMP '{text(hi)}'"
        for lo, hi in zip(cuts, cuts[1:])
    ]


def read_jdbc(spark: SparkSession, url: str, table: str, ts: str, window: tuple[int, int],
              properties: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """An external table over the network, read as one Spark partition per hour.

    Credentials come in with `properties`; none are kept here. With `schema` the
    columns get its names and types.
    """
    found = spark.read.jdbc(url, table, predicates=hour_predicates(ts, *window), properties=properties)
    return found if schema is None else with_types(found, schema)


def flow_alerts_view(flows: DataFrame) -> DataFrame:
    """Flows that carry an alert, under the names of the alerted-flow table."""
    columns = [
        F.col("CLI_IP").alias("cli_ip"),
        F.col("FIRST_SEEN").alias("tstamp"),
        F.col("FLOW_RISK").alias("flow_risk_bitmap"),
        F.col("SRV_PORT").alias("srv_port"),
        F.col("JSON").alias("json"),
    ]
    day = day_column(flows, "FIRST_SEEN")
    alerted = flows.filter(F.col("STATUS") != 0).select(*columns, *([F.col(day)] if day else []))
    return laid_out_by_day(alerted, "tstamp", day)


def write_by_day(df: DataFrame, path: str, ts: str, mode: str = "replace_days") -> None:
    """Store a table by day.

    By default the days present in df replace those stored, so a job that runs again doubles
    nothing; "append" adds to them. The rebalance hint lets AQE split a day that holds most of the rows into
    many files, where a plain repartition by day would put it into one task.
    """
    writer = (
        df.withColumn(PARTITION_COLUMN, F.to_date(ts))
        .hint("rebalance", PARTITION_COLUMN)
        .sortWithinPartitions(PARTITION_COLUMN, ts)
        .write.partitionBy(PARTITION_COLUMN)
    )
    if mode == "replace_days":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)
