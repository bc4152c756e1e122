"""Service novelty: what a host uses now and never used in its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.timewin import HOUR, current_window, history_window, in_windows, instant
from wardline.params import RiskParams


def service_novelty(df: DataFrame, p: RiskParams, host: str, ts: str, item: str) -> DataFrame:
    """(host, item) pairs of the current window that are absent from the host's history.

    A pair is new exactly when its first sight within history and current window
    lies in the current one, so one minimum per pair stands for the difference
    of the two sets. The learning period of the host is the earliest of its
    pairs; both uses read the same shuffle. A host counts only once its history
    reaches back over the learning period. Rows without an item say nothing about services and are left out.
    """
    p = p.pinned()
    start, _ = history_window(p)
    now_start, end = current_window(p)
    pairs = in_windows(df, ts, (start, end)).filter(F.col(item).isNotNull()).groupBy(host, item).agg(F.min(ts).alias("first_seen"))
    learned = pairs.groupBy(host).agg(F.min("first_seen").alias("known_since")).filter(
        f"known_since <= {instant(now_start - p.novelty_learning_hours * HOUR)}")
    novel = pairs.filter(f"first_seen >= {instant(now_start)}").select(host, item)
    return novel.join(learned.select(host), host, "left_semi")
