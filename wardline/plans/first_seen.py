"""Service novelty from a kept table of sightings, so that a run reads its current window of flows and no history.

The table holds deltas: for a window of flows, the first and the last time that each host was
seen with each item, and that it was seen at all. Minimum and maximum don't mind rows that are
taken in twice, so deltas may overlap, and a job that runs again changes nothing. Each delta
says which window it covers; a run whose history has a gap is refused.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.timewin import HOUR, current_window, history_window, in_windows, instant, merged
from wardline.params import RiskParams
from wardline.sources.tables import delete_path, path_exists

#: Bits of the filter that history is tested with before the join: a broadcast table of at most BLOOM_BITS / 64 rows.
BLOOM_BITS = 1 << 24


def _seen(rows: DataFrame, first: str, last: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(first).alias("first_seen"), F.max(last).alias("last_seen"))


def _write(pairs: DataFrame, hosts: DataFrame | None, path: str, window: tuple[int, int]) -> None:
    start, end = window
    covers = pairs.sparkSession.range(1).selectExpr(
        f"{instant(start)} AS covers_from", f"{instant(end)} AS covers_until")
    for name, rows in (("pairs", pairs), ("hosts", hosts), ("covers", covers)):  # what it covers is said last
        if rows is None:  # the hosts follow from the pairs just stored, without another pass over the rows
            kept = pairs.sparkSession.read.schema(T.StructType([*pairs.schema, T.StructField("delta", T.StringType())]))
            rows = _seen(kept.parquet(f"{path}/pairs").filter(F.col("delta") == f"{start}-{end}"), "first_seen", "last_seen", "host")
        (
            rows.withColumns({"until": F.expr(f"to_date({instant(end - 1)})"), "delta": F.lit(f"{start}-{end}")})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("until", "delta").parquet(f"{path}/{name}")
        )


def add_sightings(rows: DataFrame, path: str, window: tuple[int, int], host: str, ts: str, item: str) -> None:
    """Store what the rows of a window show. The same window replaces itself; rows without an item are left out."""
    if window[0] >= window[1]:
        raise ValueError("the window is empty")
    rows = in_windows(rows, ts, window).filter(F.col(item).isNotNull()).select(
        F.col(host).alias("host"), F.col(item).alias("item"), F.col(ts).alias("at"))
    pairs = _seen(rows, "at", "at", "host", "item")
    _write(pairs, None, path, window)


def _covers(spark: SparkSession, path: str) -> list[tuple[int, int, str, str]]:
    """Windows of the deltas, with the names of their partitions: a row for each delta."""
    if not path_exists(spark, f"{path}/covers"):
        return []
    found = spark.read.parquet(f"{path}/covers").selectExpr(
        "unix_seconds(covers_from)", "unix_seconds(covers_until)", "CAST(until AS STRING)", "CAST(delta AS STRING)")
    return sorted(tuple(row) for row in found.collect())


def compact(spark: SparkSession, path: str, before: int, forget_before: int | None = None) -> None:
    """Merge the deltas that end at `before` or earlier into one, and drop what was last seen before `forget_before`.

    A compacted delta knows only the first and last sight in its whole window. So `before` should lie at least the learning
    period before the current window of any later run, and `forget_before` before its history; other runs are
    refused. A merge that breaks off leaves the old deltas, which add nothing to the new one.
    """
    old = [c for c in _covers(spark, path) if c[1] <= before]
    if len(old) < 2:
        return
    start, end = min(c[0] for c in old), max(c[1] for c in old)
    if len(merged([c[:2] for c in old])) > 1:
        raise ValueError("the deltas to merge leave gaps between them; store those windows first")
    kept = F.lit(True)
    if forget_before is not None:
        start, kept = max(start, min(forget_before, end - 1)), F.expr(f"last_seen >= {instant(forget_before)}")
    names = [c[3] for c in old]

    def merge(name: str, *keys: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{name}").filter(F.col("delta").isin(names)).filter(kept)
        return _seen(rows, "first_seen", "last_seen", *keys)

    if (start, end) in [c[:2] for c in old]:
        raise ValueError(f"there is a delta of the merged window {start}-{end} already")
    _write(merge("pairs", "host", "item"), merge("hosts", "host"), path, (start, end))
    for _, _, until, delta in old:
        for name in ("covers", "pairs", "hosts"):  # from here on nobody relies on it
            delete_path(spark, f"{path}/{name}/until={until}/delta={delta}")


def _require_cover(covers: Iterable[tuple[int, int, str, str]], history: tuple[int, int], learned_by: int) -> None:
    start, end = history
    covers = [c[:2] for c in covers]
    inside = merged([(max(a, start), min(b, end)) for a, b in covers])
    if inside != [(start, end)]:
        raise ValueError(f"the table of sightings does not cover the history from epoch {start} to {end}, only {inside}")
    # First and last sight of a delta tell whether there was one on the near side of one edge, not between two.
    if any(a < start and b > edge for a, b in covers for edge in (learned_by + 1, end)):
        raise ValueError("a delta reaches from before the history into its last part; it was compacted too far")


def bloom_words(rows: DataFrame, *keys: str, bits: int = BLOOM_BITS) -> DataFrame:
    """(word, mask): a filter of the keys of `rows`, at most bits / 64 rows whatever the number of keys."""
    word, bit = _place(keys, bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return rows.groupBy(word.alias("word")).agg(F.bit_or(one).alias("mask"))


def _place(keys: tuple[str, ...], bits: int):
    """Word and bit of the filter for a key."""
    h = F.xxhash64(*keys)
    return F.pmod(h, F.lit(bits // 64)), F.shiftrightunsigned(h, 58).cast("int")


def might_contain(rows: DataFrame, words: DataFrame, *keys: str, bits: int = BLOOM_BITS) -> DataFrame:
    """The rows whose key may be in the filter; none that is gets lost. The filter is broadcast, its size being bounded."""
    word, bit = _place(keys, bits)
    columns = rows.columns
    hit = F.call_function("shiftright", F.col("mask"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.withColumn("word", word).join(F.broadcast(words), "word").filter(hit).select(*columns)


def novelty_from_sightings(df: DataFrame, path: str, p: RiskParams, host: str, ts: str, item: str) -> DataFrame:
    """The rows of service_novelty, from the current window of `df` and the stored sightings of the history."""
    p = p.pinned()
    spark, now, history = df.sparkSession, current_window(p), history_window(p)
    learned_by = now[0] - p.novelty_learning_hours * HOUR
    _require_cover(_covers(spark, path), history, learned_by)
    today = in_windows(df, ts, now).filter(F.col(item).isNotNull()).groupBy(
        F.col(host).alias("host"), F.col(item).alias("item")).agg(F.max(ts).alias("last"))

    def stored(name: str, until: int) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").filter(
            f"until >= to_date({instant(history[0])}) AND last_seen >= {instant(history[0])} AND first_seen < {instant(until)}")

    pairs = might_contain(stored("pairs", history[1]).select("host", "item"), bloom_words(today, "host", "item"), "host", "item")
    novel = today.join(pairs, ["host", "item"], "left_anti")
    # Hosts with an old sight; a sight of the current window is too young to count.
    learned = stored("hosts", learned_by + 1).select("host")
    return novel.join(learned, "host", "left_semi").select(F.col("host").alias(host), F.col("item").alias(item))
