"""The tables a scoring run reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from wardline.functions.timewin import laid_out_by_day
from wardline.sources.tables import flow_alerts_view

UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


@dataclass(frozen=True)
class MetricInputs:
    flows: DataFrame
    host_alerts: DataFrame
    alerted_flows: DataFrame | None = None  # a ready alerted-flow table, if there is one
    profile: DataFrame | None = None  # stored hours: history then comes from here, and not from the flows
    flows_cover: tuple[tuple[int, int], ...] = ()  # windows of epochs in which the flows are complete, idle hours included
    profile_gaps: list | None = None  # hours to read raw beside the profile; a run fills it in, so that it is looked up once
    day_column: str | None = None  # partition column of all tables that holds the date of their time column

    def __post_init__(self) -> None:
        for name, ts in (("flows", "FIRST_SEEN"), ("host_alerts", "tstamp"), ("alerted_flows", "tstamp")):
            if self.day_column and getattr(self, name) is not None:
                object.__setattr__(self, name, laid_out_by_day(getattr(self, name), ts, self.day_column))
        # Hours, weekdays and the days of a daily layout are read in the session
        # zone; another local zone is a parameter, not a session setting.
        zone = self.flows.sparkSession.conf.get("spark.sql.session.timeZone")
        if zone not in UTC_NAMES:
            raise ValueError(f"spark.sql.session.timeZone must be UTC, it is {zone}")

    @property
    def flow_alerts(self) -> DataFrame:
        if self.alerted_flows is not None:
            return self.alerted_flows
        return flow_alerts_view(self.flows)
