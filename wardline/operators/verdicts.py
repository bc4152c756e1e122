"""The rule of each metric: from the measures of a host to flag, penalty and details.

A rule is a set of expressions over a frame with one row per host. The metrics
and the fused scoring plan share them, so a rule exists once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import CAUSE_LABELS
from wardline.operators.baseline import robust_z
from wardline.params import RiskParams

# Scenario texts of the reputation metric.
REP_PERSISTENT = "COMPROMISSIONE PERSISTENTE (C2 attivo - hits ripetuti)"
REP_ISOLATED = "CONTATTO ISOLATO a server BL (possibile beacon iniziale)"
REP_TARGETED = "SCANSIONE MIRATA (target persistente)"
REP_RARE = "SCANSIONE RARA (rumore di fondo Internet)"

# Categories of the scan metric.
SCAN_VICTIM = "VITTIMA (rx_only_scan) - esclusa"
SCAN_EVASION = "EVASIONE FIREWALL (FIN/RST scan)"
SCAN_SYN = "SYN SCAN CLASSICO"
SCAN_INCOMPLETE = "INCOMPLETE FLOWS (scan base)"

NOT_DETAILS = ("host_ip", "timestamp")


@dataclass(frozen=True)
class Verdict:
    """All parts are SQL text over the measures; details map names to expressions."""

    key: str
    fired: str
    details: dict[str, str]
    penalty: str
    comparable: str = "true"  # hosts that can be judged at all

    def _select(self, hosts: DataFrame, flag: str, penalty: str) -> DataFrame:
        return hosts.selectExpr(
            "host_ip", f"{flag} AS {self.key}",
            *[f"{expression} AS {name}" for name, expression in self.details.items()],
            f"{penalty} AS penalita", "current_timestamp() AS timestamp")

    def flagged(self, hosts: DataFrame) -> DataFrame:
        """The hosts that fire, in the shape of the metric."""
        return self._select(hosts.filter(f"({self.comparable}) AND ({self.fired})"), "1", self.penalty)

    def compared(self, hosts: DataFrame) -> DataFrame:
        """Every host that can be judged, the flag being 0 or 1."""
        def flag(one: str) -> str:
            return f"CASE WHEN {self.fired} THEN {one} ELSE 0 END"

        return self._select(hosts.filter(self.comparable), flag("1"), flag(self.penalty))

    def as_struct(self) -> str:
        """Details and penalty of a firing host, else NULL."""
        fields = ", ".join(f"'{n}', {e}" for n, e in [*self.details.items(), ("penalita", self.penalty)])
        return (f"CASE WHEN ({self.comparable}) AND ({self.fired})"
                f" THEN named_struct({fields}) END AS {self.key}")


def by_window(flagged: DataFrame) -> DataFrame:
    """Rows of subjects (ref, ip) with the two as columns."""
    return flagged.select("host_ip.ref", F.col("host_ip.ip").alias("host_ip"),
                          *[c for c in flagged.columns if c != "host_ip"])


def _same(*names: str) -> dict[str, str]:
    return {name: name for name in names}


def _cases(values: tuple, *conditions: str) -> str:
    """The value of the first condition that holds, else the last value."""
    shown = [str(v) if isinstance(v, int) else f"'{v}'" for v in values]
    branches = " ".join(f"WHEN {c} THEN {v}" for c, v in zip(conditions, shown))
    return f"CASE {branches} ELSE {shown[-1]} END"


def reputation(p: RiskParams) -> Verdict:
    levels = (f"hits_srv >= {p.rep_srv_persistent_from}", "hits_srv >= 1",
              f"hits_cli >= {p.rep_cli_targeted_from}")
    scenarios = (REP_PERSISTENT, REP_ISOLATED, REP_TARGETED, REP_RARE)
    penalties = (p.penalty_rep_srv_persistent, p.penalty_rep_srv,
                 p.penalty_rep_cli_targeted, p.penalty_rep_cli)
    return Verdict(
        "M_rep",
        fired="hits_srv + hits_cli > 0",
        details={**_same("hits_srv", "hits_cli"), "hits_totali": "hits_srv + hits_cli",
                 "scenario": _cases(scenarios, *levels)},
        penalty=_cases(penalties, *levels),
    )


def certificate(p: RiskParams) -> Verdict:
    kinds = ["hits_self_signed", "hits_sha1"]
    if p.bit_expired is not None:
        kinds.insert(1, "hits_expired")
    total = " + ".join(kinds)
    return Verdict("M_cert", fired=f"{total} > 0", details={**_same(*kinds), "hits_totali": total},
                   penalty=str(p.penalty_cert))


def missing_sni(p: RiskParams) -> Verdict:
    return Verdict("M_sni", fired="hits_missing > 0", details=_same("hits_missing"),
                   penalty=str(p.penalty_sni))


def server_ports(p: RiskParams, hits: str = "hits_totali") -> Verdict:
    return Verdict("M_srv", fired=f"{hits} > 0", penalty=str(p.penalty_srv),
                   details={"hits_totali": hits, **_same("porte_distinte", "lista_porte")})


def protocol_mismatch(p: RiskParams) -> Verdict:
    return Verdict("M_proto", fired="hits_totali > 0", penalty=str(p.penalty_proto),
                   details=_same("hits_totali", "combinazioni_distinte", "lista_mismatch"))


def scan_severity(codes: str, p: RiskParams) -> dict[str, Column]:
    """Penalty and category of one scan alert; a victim weighs nothing."""
    def has(code: int) -> str:
        return f"array_contains({codes}, {code})"

    kinds = (has(1), f"{has(3)} OR {has(4)}", has(2))
    penalties = (0, p.penalty_scan_evasion, p.penalty_scan_syn, p.penalty_scan_incomplete)
    categories = (SCAN_VICTIM, SCAN_EVASION, SCAN_SYN, SCAN_INCOMPLETE)
    return {"penalty": F.expr(_cases(penalties, *kinds)), "category": F.expr(_cases(categories, *kinds))}


def scan_rank(codes: str) -> Column:
    """0 for a victim, then the kinds of attack from the mildest to the worst."""
    def has(code: int) -> str:
        return f"array_contains({codes}, {code})"

    return F.expr(_cases((0, 3, 2, 1), has(1), f"{has(3)} OR {has(4)}", has(2)))


def scan_worst(rank: str, p: RiskParams) -> dict[str, Column]:
    """Penalty and category of a host's largest rank."""
    kinds = (f"{rank} = 3", f"{rank} = 2")
    return {
        "penalita_massima": F.expr(_cases(
            (p.penalty_scan_evasion, p.penalty_scan_syn, p.penalty_scan_incomplete), *kinds)),
        "categoria_dominante": F.expr(_cases((SCAN_EVASION, SCAN_SYN, SCAN_INCOMPLETE), *kinds)),
    }


def scan(p: RiskParams, hits: str = "hits_totali") -> Verdict:
    return Verdict("M_scan", fired=f"{hits} > 0", penalty="penalita_massima", details={
        "hits_totali": hits, **_same("codici_rilevati", "codici_descritti", "categoria_dominante")})


def volume(p: RiskParams) -> Verdict:
    """Outgoing bytes against the host's own hourly baseline."""
    mad_eff = f"greatest(v_mad, v_mediana * {p.vol_mad_fraction}D, {p.vol_mad_floor}D)"
    z = robust_z("v_out", "v_mediana", mad_eff)
    return Verdict(
        "M_vol",
        comparable=f"n_totali > 0 AND bucket_baseline >= {p.min_baseline_buckets}",
        fired=f"v_out > {p.vol_min_bytes} AND v_out > v_mediana AND {z} > {p.vol_z}D",
        details={
            "v_out": "v_out",
            "v_mediana": "CAST(v_mediana AS BIGINT)",
            "mad": "CAST(v_mad AS BIGINT)",
            "mad_eff": f"CAST({mad_eff} AS BIGINT)",
            "z_modified": z,
            **_same("categoria_temporale", "bucket_baseline"),
        },
        penalty=str(p.penalty_vol),
    )


def failure_rate(p: RiskParams) -> Verdict:
    """Failed share of the current flows against the host's own hourly baseline."""
    rate = "try_divide(CAST(n_falliti AS DOUBLE), n_totali)"
    mad_eff = f"greatest(r_mad, {p.fail_mad_floor}D)"
    z = robust_z(rate, "r_mediana", mad_eff)
    causes = ", ".join(f"'{cause}', n_{cause}" for cause in CAUSE_LABELS)
    return Verdict(
        "M_fail",
        comparable=f"n_totali >= {p.fail_min_flows} AND bucket_baseline >= {p.min_baseline_buckets}",
        fired=f"{rate} > {p.fail_min_rate}D AND {rate} > r_mediana AND {z} > {p.fail_z}D",
        details={
            **_same("n_totali", "n_falliti"),
            "r_corrente": rate,
            "r_mediana": "r_mediana",
            "mad": "r_mad",
            "mad_eff": mad_eff,
            "z_modified": z,
            "bucket_count": "bucket_baseline",
            "categoria_temporale": "categoria_temporale",
            "breakdown": f"named_struct({causes})",
            "causa_dominante": f"({_dominant(f'named_struct({causes})')}).causa",
        },
        penalty=str(p.penalty_fail),
    )


def _dominant(breakdown: str) -> str:
    ranked = ", ".join(
        f"named_struct('conteggio', {breakdown}.{cause}, 'precedence', {-position}, 'causa', '{label}')"
        for position, (cause, label) in enumerate(CAUSE_LABELS.items()))
    return f"array_max(array({ranked}))"


def dominant_cause(breakdown: str) -> Column:
    """Most frequent failure cause, as struct(causa, conteggio); ties go to the first cause."""
    return F.expr(_dominant(breakdown))
