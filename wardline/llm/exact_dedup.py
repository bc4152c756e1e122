"""Exact de-duplication over an extendible-hash index on shared files.

Equal texts fall on the same 64-bit key. A directory of key prefixes, doubled as long as a
bucket holds too many keys, tells the bucket of a key. Every text goes to its bucket, copies
combined on the map side first, so a group of copies that holds a third of all rows sends one
row per map task. There texts of one key are compared byte by byte; those that differ
under the same key form a chain, and each link of it is one group of equal texts. Owner tasks
write whole buckets to files in the shared folder. The documents then find their group by
bucket, key and digest.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import Shelf, unused

#: Least number of prefix bits that are counted for the directory; more where there are more keys than that serves.
PREFIX_BITS = 18


def prefix(key: Column, depth: Column | int, bits: int = PREFIX_BITS) -> Column:
    """The upper `depth` of the upper `bits` bits of an unsigned 64-bit key; 0 at depth 0."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    top = F.shiftrightunsigned(key, 64 - bits)
    return F.call_function("shiftright", top, (F.lit(bits) - depth).cast("int"))


def prefix_bits(keys: int, capacity: int, least: int = PREFIX_BITS) -> int:
    """Bits after which buckets of so many hashed keys are several times below their capacity."""
    return min(60, max(least, ceil(log2(max(1, keys) / capacity)) + 4))


def directory(shelf: Shelf, keys: DataFrame, capacity: int, bits: int = PREFIX_BITS) -> tuple[DataFrame, int]:
    """(entry, depth, bucket) and the global depth: one row per prefix of that depth that holds keys.

    `keys` holds each key once. Buckets start as one of depth 0. While a bucket holds more than `capacity` keys, the
    directory doubles and the overfull buckets split on their next bit; the others keep
    their depth and share several directory entries. The keys were counted per prefix
    once, so doubling works on at most 2**bits rows. Keys that agree in all `bits` bits stay together.
    """
    counts = (
        keys.groupBy(prefix(F.col("key"), bits, bits).alias("slot_prefix"))
        .agg(F.count("*").alias("keys"))
        .withColumns({"depth": F.lit(0), "bucket": F.lit(0).cast("long")})
    )
    counts = shelf.keep(counts.coalesce(1) if bits <= PREFIX_BITS else counts, "directory-0")
    global_depth = 0
    for depth in range(1, bits + 1):
        held = F.sum("keys").over(Window.partitionBy("depth", "bucket"))
        overfull = counts.filter(F.col("depth") == depth - 1).groupBy("bucket").agg(F.sum("keys").alias("held")).filter(
            F.col("held") > capacity)
        if overfull.isEmpty():
            break
        split = (F.col("depth") == depth - 1) & (held > capacity)
        counts = shelf.keep(
            counts.withColumn("split", split).select(
                "slot_prefix", "keys",
                F.when(F.col("split"), depth).otherwise(F.col("depth")).alias("depth"),
                F.when(F.col("split"), F.call_function("shiftright", "slot_prefix", F.lit(bits - depth)))
                .otherwise(F.col("bucket")).alias("bucket"),
            ),
            f"directory-{depth}",
        )
        global_depth = depth
    entry = F.call_function("shiftright", "slot_prefix", F.lit(bits - global_depth))
    return shelf.keep(counts.select(entry.alias("entry"), "depth", "bucket").distinct(), "directory"), global_depth


def exact_dedup(
    docs: DataFrame, normalise=lambda text: text, capacity: int = 65_536, hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    `normalise` maps the text column to the text that is compared. Null texts count as
    empty, and all empty texts are one group. The row with the largest doc_id of a group
    stays; null ids lose against any id. Rows that repeat a doc_id and its text are the
    same document: all carry the same verdict and each counts in group_size. Other
    columns of `docs` are not read. `capacity` bounds the keys of a bucket; `hash_bits`
    shortens the key, for trials of the collision chains.
    """
    shelf = Shelf(docs.sparkSession, "exact-dedup")
    body = F.coalesce(normalise(F.col("text")), F.lit(""))
    keyed = docs.select("doc_id", body.alias("body")).select(
        "doc_id", "body", F.shiftleft(F.xxhash64("body"), 64 - hash_bits).alias("key"),
        F.sha2("body", 256).alias("text_sha256"))

    keys = shelf.keep(keyed.groupBy("key").agg(F.count("*").alias("rows")), "keys").select("key")
    bits = prefix_bits(keys.count(), capacity)
    places, global_depth = directory(shelf, keys, capacity, bits)
    small = global_depth <= PREFIX_BITS  # then it has at most 2**PREFIX_BITS rows

    def in_bucket(rows: DataFrame) -> DataFrame:
        return rows.withColumn("entry", prefix(F.col("key"), global_depth, bits)).join(
            F.broadcast(places) if small else places, "entry").drop("entry")

    # Grouping by the text itself, in its bucket and under its key, compares bytes.
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256"))
    index = shelf.keep(
        in_bucket(keyed.drop("text_sha256")).groupBy("bucket", "key", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .withColumn("text_sha256", F.sha2("body", 256)).drop("body")
        .repartition("bucket").withColumn("chain", chain),
        "index",
    )
    return in_bucket(keyed.select("doc_id", "key", "text_sha256")).drop("depth").join(
        index, ["bucket", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        "bucket", "chain")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns kept: one row of each distinct text.

    Rows that repeat both the doc_id and the text that stay are reduced to one of them.
    """
    ident, sha, n = unused(docs.columns, "id_", "sha_", "rows_")
    verdicts = exact_dedup(docs.select("doc_id", "text")).filter("kept")
    stays = Shelf(docs.sparkSession, "exact-dedup").keep(
        verdicts.groupBy(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(n)), "stays")
    marked = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    same = lambda right: marked["doc_id"].eqNullSafe(right[ident]) & (marked[sha] == right[sha])
    repeated, single = stays.filter(f"{n} > 1"), stays.filter(f"{n} = 1")
    if repeated.isEmpty():
        return marked.join(stays, same(stays), "left_semi").drop(sha)
    return (marked.join(single, same(single), "left_semi")
            .union(marked.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", sha]))
            .drop(sha))
