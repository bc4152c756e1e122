"""All thresholds, penalties and windows of the engine, as one immutable value."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from datetime import datetime, timezone

# Scoring bands, penalties, thresholds, alert ids and risk bit
# numbers of the detection model.
LOCAL_NETWORKS = ("192.168.0.0/16", "10.0.0.0/8", "172.16.0.0/12", "147.32.0.0/16")
NEVER_EXTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")
MIB = 1024 * 1024


@dataclass(frozen=True)
class RiskParams:
    # Reference instants: epoch seconds, datetime or ISO text, UTC unless they say
    # otherwise. None or 0 is "now".
    flows_ref: int | datetime | str | None = None
    alerts_ref: int | datetime | str | None = None  # None follows flows_ref
    open_alerts: bool | None = None  # host alerts without upper bound; None: only when "now"
    local_tz: str = "UTC"  # zone in which hours and weekdays are read

    local_networks: tuple[str, ...] = LOCAL_NETWORKS
    never_external: tuple[str, ...] = NEVER_EXTERNAL

    score_max: int = 100
    yellow_from: int = 30
    red_from: int = 60
    systemic_from: int = 2  # critical hosts from which the network state is systemic

    alert_window_minutes: int = 60
    current_window_hours: int = 1
    history_days: int = 7
    min_baseline_buckets: int = 30
    working_hours: tuple[int, int] = (9, 17)  # both inclusive
    weekend_days: tuple[int, ...] = (6, 7)  # 1 = Monday

    penalty_vol: int = 20
    penalty_fail: int = 30
    penalty_srv: int = 20
    penalty_sni: int = 50
    penalty_cert: int = 40
    penalty_proto: int = 25

    vol_z: float = 3.0
    vol_mad_fraction: float = 0.10
    vol_mad_floor: int = MIB
    vol_min_bytes: int = 50 * MIB

    fail_z: float = 3.0
    fail_min_rate: float = 0.30
    fail_mad_floor: float = 0.05
    fail_min_flows: int = 50
    bit_error_code: int = 43
    bit_unidirectional: int = 46
    bit_tcp_issues: int = 50
    bit_unresolved: int = 51
    bit_probing: int = 55

    scan_alert_id: int = 15
    penalty_scan_evasion: int = 50
    penalty_scan_syn: int = 40
    penalty_scan_incomplete: int = 30
    srv_alert_id: int = 29

    bit_missing_sni: int = 24
    bit_self_signed: int = 6
    bit_sha1: int = 29
    bit_expired: int | None = None  # 9 switches expired certificates on
    bit_nonstandard_port: int = 5

    rep_srv_persistent_from: int = 3
    rep_cli_targeted_from: int = 11
    penalty_rep_srv: int = 30
    penalty_rep_srv_persistent: int = 50
    penalty_rep_cli: int = 5
    penalty_rep_cli_targeted: int = 15

    list_limit: int | None = 10  # entries in the short lists of ports, protocols and codes; None: all
    list_width: int = 40  # longest metric list shown whole as text in the suspect table
    novelty_learning_hours: int = 24  # history a host needs before novelty counts

    def __post_init__(self) -> None:
        if not self.local_networks:
            raise ValueError("local_networks must name at least one network")
        for name in ("alert_window_minutes", "current_window_hours", "history_days", "list_limit"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @property
    def flows_epoch(self) -> int:
        return _epoch(self.flows_ref)

    @property
    def alerts_epoch(self) -> int:
        return self.flows_epoch if self.alerts_ref is None else _epoch(self.alerts_ref)

    @property
    def replays_alerts(self) -> bool:
        """The alert reference is a given instant and not "now"."""
        if self.open_alerts is not None:
            return not self.open_alerts
        return bool(self.flows_ref if self.alerts_ref is None else self.alerts_ref)

    def pinned(self) -> RiskParams:
        """The same parameters with "now" read once, so that one run sees one instant."""
        return replace(self, flows_ref=self.flows_epoch, alerts_ref=self.alerts_epoch,
                       open_alerts=not self.replays_alerts)

    @property
    def fail_bits(self) -> tuple[int, ...]:
        return (self.bit_error_code, self.bit_unidirectional, self.bit_tcp_issues,
                self.bit_unresolved, self.bit_probing)

    @property
    def cert_bits(self) -> tuple[int, ...]:
        bits = (self.bit_self_signed, self.bit_expired, self.bit_sha1)
        return tuple(b for b in bits if b is not None)


def _epoch(ref: int | datetime | str | None) -> int:
    if not ref:
        return int(time.time())
    if isinstance(ref, str):
        ref = datetime.fromisoformat(ref)
    if isinstance(ref, datetime):
        aware = ref if ref.tzinfo else ref.replace(tzinfo=timezone.utc)
        return int(aware.timestamp())
    return int(ref)
