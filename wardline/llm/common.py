"""What the operators share: input tables, the words of a text, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.plans.lineage import ensure_checkpoint_dir

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, made longer where a column is called so already, whatever its case."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall into the fold of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone, so reruns and retried tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


class Shelf:
    """Intermediate tables of one run, written to the folder that all executors share.

    A written table cuts the lineage, survives the loss of executors and is read
    with column pruning.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
        self.spark = spark
        self.path = f"{base.rstrip('/')}/wardline-{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, seed: int = 0,
) -> DataFrame:
    """(doc_id, text, label, lot): at most `per_class` training documents of each label 0 and 1.

    The rows with the smallest hashes are taken, so the sample does not depend on the
    layout; `lot` is that hash, for further splits. Labels that repeat a doc_id count as
    their largest; null labels and ids are left out. Only ids move before the choice is made.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label"))
    ids = docs.select("doc_id").filter(train).join(known, "doc_id").distinct().withColumn(
        "lot", F.xxhash64(F.lit(seed), "doc_id"))
    chosen = None
    for value in (0, 1):
        part = ids.filter(F.col("label") == value).orderBy("lot", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows
            .dropDuplicates(["doc_id"]))


def logistic(z):
    """1 / (1 + exp(-z)) without overflow."""
    import numpy as np

    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, dtype=float)))
