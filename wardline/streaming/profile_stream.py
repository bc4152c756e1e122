"""The hourly profile from a stream of flows, without state.

Bytes, flows and failed flows add up, so every micro-batch appends its own
partial sums and merged_profile adds them on reading. No watermark is needed:
late flows join their hour whenever they come, and nothing is dropped. Rows without a host
tell from where to where a stream has come, so that idle hours between are known to be idle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline import schemas
from wardline.functions.timewin import HOUR, hour_bucket, merged, whole_hour
from wardline.operators.baseline import hourly_profile
from wardline.params import RiskParams
from wardline.plans.lineage import cut_lineage
from wardline.plans.profile import covering, write_profile_rows
from wardline.sources.tables import path_exists

SUMS = ("bytes_out", "flows", "failed")
PARTIALS = ("host long, bucket timestamp, part_bytes_out long, part_flows long, part_failed long, "
            "dt date, stream string, batch long")


def require_known_batches(spark: SparkSession, path: str, checkpoint: str, stream: str) -> None:
    """Refuse a checkpoint that doesn't know the batches of this stream in the table."""
    if path_exists(spark, f"{checkpoint}/metadata") or not path_exists(spark, path):
        return
    if not spark.read.schema("stream string").parquet(path).filter(F.col("stream") == stream).isEmpty():
        raise ValueError(f"{path} has batches of stream '{stream}' that the checkpoint {checkpoint} does not know")


def stream_profile(flows: DataFrame, path: str, checkpoint: str, p: RiskParams,
                   available_now: bool = True, stream: str = "flows", since: int | None = None) -> StreamingQuery:
    """Append the partial sums of every micro-batch to the table at `path`.

    A batch replaces its own partitions, those of its stream and number, so one that is
    replayed after a failure is not counted twice. Numbers start anew with a new checkpoint: batches of the
    table that it doesn't know would be replaced, or their flows counted again, so the start is refused. Flows from
    elsewhere add to the same table under another `stream` name. The stream covers the hours from `since`, by default that of
    the earliest flow in its first batch, to its latest flow. `available_now` takes in what has arrived and stops,
    which suits an hourly job; otherwise the query keeps running.
    """
    def reached(batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows without a host: the last hour of the batch, and the first one of the stream."""
        hour = hour_bucket("FIRST_SEEN", p)
        first = F.min(hour) if since is None else F.timestamp_seconds(F.lit(whole_hour(since, p)))
        edges = [F.max(hour), first] if batch_id == 0 else [F.max(hour)]
        return (
            batch.agg(F.array(*edges).alias("edges")).select(F.explode("edges").alias("bucket")).filter("bucket IS NOT NULL")
            .selectExpr("CAST(NULL AS BIGINT) AS host", "bucket", *[f"0L AS {c}" for c in SUMS])
        )

    def append(batch: DataFrame, batch_id: int) -> None:
        (
            hourly_profile(batch, p).unionByName(reached(batch, batch_id))
            .withColumnsRenamed({c: f"part_{c}" for c in SUMS})
            .withColumns({"stream": F.lit(stream), "batch": F.lit(batch_id)})
            .withColumn("dt", F.to_date("bucket"))
            .hint("rebalance", "dt")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "stream", "batch").parquet(path)
        )

    require_known_batches(flows.sparkSession, path, checkpoint, stream)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (
        flows.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """The stored partial sums; several rows per host and hour are expected, and all count.

    Their columns are not those of a profile, so they can't be taken for one unmerged. Rows without a host
    tell how far a stream has come. A table that nothing has been written to yet has no rows.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], PARTIALS)
    return spark.read.schema(PARTIALS).parquet(path)


def covered_windows(partials: DataFrame) -> list[tuple[int, int]]:
    """From the first to the last hour of every stream: one row per stream comes to the driver."""
    spans = partials.filter("host IS NULL").groupBy("stream").agg(
        F.min(F.unix_seconds("bucket")), F.max(F.unix_seconds("bucket")))
    return merged([(first, last + HOUR) for _, first, last in spans.collect()])


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Merge all partial sums at `path` into a profile at `target`, a few files an hour.

    The hours present are replaced, so it may run again at any time; the partial sums stay. Hours that the streams
    cover and in which there were no flows are noted as idle, unless the target has flows of them from elsewhere.
    """
    partials = read_partials(spark, path)
    hours = _sums(partials)
    idle = spark.createDataFrame([], "bucket timestamp")
    for start, end in covered_windows(partials):
        idle = idle.union(spark.range(start, end, HOUR).selectExpr("timestamp_seconds(id) AS bucket"))
    known = hours.select("bucket")
    if path_exists(spark, target):
        known = known.union(spark.read.schema(schemas.PROFILE).parquet(target).filter("host IS NOT NULL").select("bucket"))
    idle = idle.join(known.distinct(), "bucket", "left_anti").selectExpr(
        "CAST(NULL AS BIGINT) AS host", "bucket", *[f"0L AS {c}" for c in SUMS])
    # The target is read above, so what replaces parts of it has to be there first.
    write_profile_rows(hours.unionByName(cut_lineage(idle)), target)


def _sums(partials: DataFrame) -> DataFrame:
    return partials.filter("host IS NOT NULL").groupBy("host", "bucket").agg(
        *[F.sum(f"part_{c}").alias(c) for c in SUMS])


def merged_profile(partials: DataFrame) -> DataFrame:
    """One row per host and hour, declared to cover what the streams have covered."""
    return covering(_sums(partials), *covered_windows(partials))
