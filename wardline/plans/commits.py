"""Results of a run as one commit: readers see all tables of a run or none.

Every run goes into a folder of its own. A marker, created when all of its tables are there,
makes it the current one; creating one file is a single step on every file system. So a run
that breaks off between two tables changes nothing for those who read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from wardline.sources.tables import create_marker, delete_path, list_names, path_exists

MARKER = "_COMMITTED"


def commit(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> str:
    """Write the tables as a new version below `path` and make it the current one; gives the name of the version.

    Versions are in the order in which their writing began. Two runs at a time don't disturb each other; the one that
    began later wins.
    """
    if not tables:
        raise ValueError("there is nothing to commit")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, frame in tables.items():
        frame.write.format(fmt).save(f"{path}/{version}/{name}")
    create_marker(frame.sparkSession, f"{path}/{version}/{MARKER}")
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """Committed versions, the current one last."""
    return sorted(name for name in list_names(spark, path) if path_exists(spark, f"{path}/{name}/{MARKER}"))


def read_committed(spark: SparkSession, path: str, version: str | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The tables of the current version, or of another. They stay those of this version when a newer one is committed."""
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise ValueError(f"{path} has no committed version{f' {version}' if version else ''}")
    place = f"{path}/{version or known[-1]}"
    return {name: spark.read.format(fmt).load(f"{place}/{name}")
            for name in list_names(spark, place) if not name.startswith(("_", "."))}


def expire(spark: SparkSession, path: str, keep: int = 24, abandoned_after: int = 24 * 3600) -> list[str]:
    """Remove all but the last `keep` committed versions, and uncommitted ones that began that many seconds ago."""
    if keep < 1:
        raise ValueError("at least the current version stays")
    known, now = versions(spark, path), time.time_ns()
    gone = known[:-keep]
    for name in set(list_names(spark, path)) - set(known):
        began = name.split("-")[0]
        if began.isdigit() and now - int(began) > abandoned_after * 1_000_000_000:
            gone.append(name)
    for name in gone:
        delete_path(spark, f"{path}/{name}/{MARKER}")  # readers first
        delete_path(spark, f"{path}/{name}")
    return sorted(gone)
