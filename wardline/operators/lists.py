"""Short lists of distinct items per host."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequent_items(pairs: DataFrame, item: str, limit: int | None, name: str, *carried: str) -> DataFrame:
    """The `limit` most frequent items of each host, listed in item order; without a limit all of them.

    This is the short form for reports; host_items has every item in a row of its own.

    `pairs` holds one row per (host_ip, item) with its `hits`. Under a row-number
    limit Spark keeps only the first rows of each group before the shuffle, so a
    host with very many items is never gathered. Ordering by hits also keeps the
    pairs identical to those the totals read, so their shuffle runs once; `carried` are
    further columns that the totals read. A NULL item with no hits comes last and is not listed.
    """
    if limit is None:
        return pairs.groupBy("host_ip").agg(F.array_sort(F.collect_list(item)).alias(name))
    order = Window.partitionBy("host_ip").orderBy(F.desc("hits"), item, *carried)
    return (
        pairs.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .groupBy("host_ip")
        .agg(F.array_sort(F.collect_list(item)).alias(name))
    )
